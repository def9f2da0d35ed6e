"""Streams over several batches and restarts, against the batch operators."""

from __future__ import annotations

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackledger.operators import audit
from trackledger.sources.snapshots import read_ledger
from trackledger.streaming import feeds

FRAMES = "cam_id long, seq long, frame_ts timestamp, frame_id long, taken timestamp"
BEGIN = dt.datetime(2026, 7, 1)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    yield
    spark.conf.set(key, before)


def frames(seed, n=300, cams=3):
    """Frames that come in nearly in order, with falling numbers, backward times and silences."""
    rnd = random.Random(seed)
    rows, at, number = [], dict.fromkeys(range(cams), 0.0), dict.fromkeys(range(cams), 0)
    for seq in range(n):
        cam = rnd.randrange(cams)
        at[cam] = max(at[cam] + rnd.choice([1, 1, 2] * 6 + [90]), seq * 4.0)
        number[cam] = 0 if rnd.random() < 0.1 else number[cam] + 1
        frame_ts = at[cam] - (50 if rnd.random() < 0.1 else 0)
        rows.append((cam, seq, BEGIN + dt.timedelta(seconds=frame_ts), number[cam], BEGIN + dt.timedelta(seconds=at[cam])))
    return rows


def feed(spark, tmp_path, parts):
    """A stream with one file, and so one batch, for each part."""
    for part in parts:
        spark.createDataFrame(part, FRAMES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return feeds.read_parquet_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], FRAMES).schema, files_per_batch=1)


@pytest.mark.parametrize("seed", range(3))
def test_monotonic_frames_over_batches(spark, tmp_path, seed):
    rows = frames(seed)
    parts = [rows[i : i + 70] for i in range(0, 300, 70)]
    for p in parts:
        random.Random(seed).shuffle(p)
    out = str(tmp_path / "out")
    take = lambda batch, i: feeds.stream_monotonic(batch.select("cam_id", "seq", "frame_ts"), i, out, ["cam_id"])
    feeds.drain_batches(feed(spark, tmp_path, parts[:3]), take, str(tmp_path / "state"))
    feeds.drain_batches(feed(spark, tmp_path, parts[3:]), take, str(tmp_path / "state"))  # stopped and started again
    whole = spark.createDataFrame(rows, FRAMES)
    expected = {r["seq"] for r in audit.monotonic_frames(whole, ["cam_id"]).collect()}
    assert {r["seq"] for r in spark.read.parquet(out).collect()} == expected
    take(whole.where(F.col("seq") >= 280), 4)  # the last batch runs again
    assert spark.read.parquet(out).count() == len(expected)


def expected_containers(rows, silence, mark):
    """Closed containers by a walk: frames up to the watermark, cut where the number falls or after a silence."""
    out, held = [], {}
    for cam, seq, ts, number, at in sorted(rows, key=lambda r: r[1]):
        if at > mark:
            continue
        k = held.get(cam)
        if k and (number < k["id"] or (at - k["at"]).total_seconds() > silence):
            out.append((cam, k["no"], k["first"], k["last"], k["n"]))
            k = held[cam] = {"no": k["no"] + 1, "first": ts, "n": 0}
        elif not k:
            k = held[cam] = {"no": 0, "first": ts, "n": 0}
        k |= {"last": ts, "id": number, "at": at, "n": k["n"] + 1}
    return sorted(out + [(cam, k["no"], k["first"], k["last"], k["n"]) for cam, k in held.items() if (mark - k["at"]).total_seconds() > silence])


@pytest.mark.parametrize("seed", range(3))
def test_containers_are_cut_in_the_stream(spark, tmp_path, rocks, seed):
    rows = frames(seed)
    parts, rnd = [rows[i : i + 60] for i in range(0, 300, 60)], random.Random(seed)
    parts[1], parts[2] = parts[1][:-5] + parts[2][:5], parts[1][-5:] + parts[2][5:]  # some come a batch late
    for p in parts:
        rnd.shuffle(p)
    run = lambda some: feeds.drain(feeds.stream_containers(feed(spark, tmp_path, some), 60, "400 seconds"), str(tmp_path / "out"), str(tmp_path / "state"))
    run(parts[:2])
    run(parts[2:])  # stopped and started again
    got = sorted((r["cam_id"], r["container"], r["first_ts"], r["last_ts"], r["n_frames"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    mark = max(r[4] for r in rows) - dt.timedelta(seconds=400)
    assert got == expected_containers(rows, 60, mark) and len(got) >= 15


class _Held:
    """A value or list of the state, and how many values went to it."""

    def __init__(self):
        self.held, self.told = [], 0

    def exists(self):
        return bool(self.held)

    def clear(self):
        self.held = []

    def get(self):
        return iter(self.held) if self.many else self.held[0]

    def update(self, value):
        self.held, self.told = [value], self.told + 1

    def appendList(self, values):  # noqa: N802
        self.held, self.told = self.held + values, self.told + len(values)

    put = appendList


class _Handle:
    def __init__(self):
        self.states = []

    def getListState(self, *_):  # noqa: N802
        self.states.append(_Held())
        self.states[-1].many = True
        return self.states[-1]

    def getValueState(self, *_):  # noqa: N802
        self.states.append(_Held())
        self.states[-1].many = False
        return self.states[-1]

    def registerTimer(self, at):  # noqa: N802
        pass


def test_waiting_frames_are_few_values_of_the_state():
    class Watermark:
        def __init__(self, at):
            self.at = at

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return int(pd.Timestamp(self.at).value // 1_000_000)

    rows = pd.DataFrame(frames(5, 900, 1), columns=["cam_id", "seq", "frame_ts", "frame_id", "taken"])
    cut, handle, got = feeds._Containers(60), _Handle(), []
    cut.init(handle)
    for i, mark in ((0, BEGIN), (300, rows["taken"][200]), (600, rows["taken"][450]), (900, rows["taken"][899] + dt.timedelta(seconds=100))):
        part = rows.iloc[i : i + 300]
        for out in cut.handleInputRows((0,), iter([part[:140], part[140:]]) if len(part) else iter([]), Watermark(mark)) if len(part) else cut.handleExpiredTimer((0,), Watermark(mark), None):
            got += [tuple(r) for r in out[["cam_id", "container", "first_ts", "last_ts", "n_frames"]].itertuples(index=False, name=None)]
    assert sorted(got) == expected_containers(rows.itertuples(index=False, name=None), 60, rows["taken"][899] + dt.timedelta(seconds=100))
    assert sum(s.told for s in handle.states) < 20


def test_submitted_days_survive_a_restart(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    parts = [["20260701", "20260702"], ["20260702", None, "20260703"], ["20260701"], ["20260704", "20260704"]]
    for p in parts:
        spark.createDataFrame([(d,) for d in p], "day string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda: feeds.read_parquet_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], "day string").schema, files_per_batch=1)
    told = []

    def take(batch, i):
        feeds.submit_days(batch, i, ledger)
        told.append(i)
        if told == [0, 1]:
            raise RuntimeError("died")  # after its entries were written

    with pytest.raises(Exception, match="died"):
        feeds.drain_batches(read(), take, str(tmp_path / "state"))
    feeds.drain_batches(read(), take, str(tmp_path / "state"))
    assert told == [0, 1, 1, 2, 3]
    assert sorted((r["day"], r["run"]) for r in read_ledger(spark, ledger).collect()) == [("20260701", "0"), ("20260702", "0"), ("20260703", "1"), ("20260704", "3")]
