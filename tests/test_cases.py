"""Small cases with known outcomes: names, windows, statuses, rollups, plans, folds, errors."""

from __future__ import annotations

import datetime as dt
import math
import os
import pathlib
import random
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from trackledger import queries as own
from trackledger.functions import names as N
from trackledger.functions import numbers as M
from trackledger.operators import accounting, audit, detections, folds, rollup, windows
from trackledger.plans import planning, status


def t(h: float, m: float = 0, s: float = 0, day: int = 1) -> dt.datetime:
    return dt.datetime(2026, 7, day) + dt.timedelta(hours=h, minutes=m, seconds=s)


SRC = "cam_id int, starttime timestamp_ntz, endtime timestamp_ntz, modified_time timestamp_ntz, file_size long"
OUT = "cam_id int, from_dt timestamp_ntz, to_dt timestamp_ntz, modified_time timestamp_ntz"


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("name, cam, start", [
    ("cam-0_20250801T090003.300824.299Z--20250801T090103.222699.929Z.mp4", 0, dt.datetime(2025, 8, 1, 9, 0, 3, 300824)),
    ("Cam_1_2026-07-16T08_15_29.782248Z--2026-07-16T08_19_11.135227Z.bbb", 1, dt.datetime(2026, 7, 16, 8, 15, 29, 782248)),
    ("Cam_11_2026-07-16T08_15_29Z--2026-07-16T08_19_11Z.bbb", 11, dt.datetime(2026, 7, 16, 8, 15, 29)),
    ("Cam_1_2026-13-16T08_15_29Z--2026-07-16T08_19_11Z.bbb", 1, None),
    ("notes.txt", None, None),
])
def test_names_are_parsed(spark, name, cam, start):
    p = one(spark, N.parse_name(F.col("n")), n=name)
    assert (p["cam_id"], p["starttime"]) == (cam, start)


def test_built_names_and_keys(spark):
    a, b = t(9), t(9, 5, 0.25)
    assert one(spark, N.build_name(F.lit(3), F.col("a"), F.col("b")), a=a, b=b) == "Cam_3_2026-07-01T09_00_00Z--2026-07-01T09_05_00.250000Z.bbb"
    assert one(spark, N.start_key(F.lit(3), F.col("b")), b=b) == "3|2026-07-01T09:05:00"
    assert one(spark, N.bucket_path(F.col("a")), a=t(22, 19, 13)) == "2026/07/01/22/00"
    assert one(spark, N.name_prefix(F.lit(1), F.col("a")), a=a) + "." not in one(spark, N.build_name(F.lit(11), F.col("a"), F.col("b")), a=a, b=b)
    assert [one(spark, N.normalize_date(F.col("d")), d=d) for d in ("2026-07-01", "2026/07/01", "20260701", "today")] == ["20260701"] * 3 + [None]
    assert one(spark, N.config_tag(F.lit(30), F.lit("hour"), F.lit(10), F.lit(200)), a=1) == "int30s_winhour"
    assert one(spark, N.config_tag(F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit(10), F.lit(200)), a=1) == "count_w10_n200_int0s"
    assert one(spark, N.remap_path(F.col("p"), [("/a/b", "/x"), ("/a", "/y")]), p="/a/bc/d") == "/y/bc/d"


def test_numbers(spark):
    for text, s in (("1-02:03:04", 93784.0), ("00:10", 10.0), ("01:00:00.5", 3600.5), ("UNLIMITED", None), ("", None)):
        assert one(spark, M.duration_seconds(F.col("d")), d=text) == s
    for text, k in (("4G", 4 * 1024**2), ("10Mc", 30 * 1024), ("1Gn", 2 * 1024**2), ("5", 5 * 1024), ("x", None)):
        assert one(spark, M.memory_kib(F.col("m"), F.lit(3), F.lit(2)), m=text) == k
    assert one(spark, M.memory_text(F.col("x")), x=4000.0) == "4G" and one(spark, M.memory_text(F.col("x")), x=1100.0) == "1280M"
    assert one(spark, M.round_minutes(F.col("x")), x=601.0) == 15


def test_edge_spanning_file_counts_in_both_hours(spark):
    src = spark.createDataFrame([(0, t(9, 50), t(10, 10), t(12), 1), (1, t(9), t(10), t(12), 1), (2, t(9), t(9), t(12), 1), (3, t(9, 1), t(9, 1), t(12), 1), (4, t(23, 59), t(24, 1), t(12), 1)], SRC)
    got = {(r["cam_id"], r["from_dt"]) for r in windows.window_units(src).collect()}
    assert got == {(0, t(9)), (0, t(10)), (1, t(9)), (3, t(9)), (4, t(23)), (4, t(24))}


@pytest.mark.parametrize("hours", [1, 5, 24])
def test_windows_equal_a_theta_join(spark, hours):
    rnd = random.Random(hours)
    rows = []
    for i in range(60):
        a = t(0, 0, rnd.randrange(0, 3 * 86400, 450))
        rows.append((i % 3, a, a + dt.timedelta(seconds=rnd.choice([0, 450, 3600, 40000, 100000])), t(1), 1))
    src = spark.createDataFrame(rows, SRC)
    days = spark.createDataFrame([(f"202607{d:02}",) for d in range(1, 7)], "day string")
    w = windows.day_windows(days, hours)
    expected = src.join(w, (F.col("starttime") < F.col("to_dt")) & (F.col("endtime") > F.col("from_dt"))).select("cam_id", "from_dt", "to_dt").distinct()
    assert set(windows.window_units(src, hours).drop("latest_src_mtime").collect()) == set(expected.collect())


def test_day_windows(spark):
    days = spark.createDataFrame([("20260701",), ("20260701",)], "day string")
    got = windows.day_windows(days).orderBy("from_dt").collect()
    assert len(got) == 24 and got[-1]["to_dt"] == t(24)
    with pytest.raises(ValueError):
        windows.day_windows(days, 0)
    with pytest.raises(Exception, match="before the start"):
        spark.range(1).select(windows.day_range(F.lit("2026-07-02"), F.lit("2026-07-01"))).collect()


def test_stale_or_done(spark):
    src = spark.createDataFrame([(c, t(9), t(9, 30), t(12), 1) for c in (0, 1, 2)] + [(0, t(10), t(10, 30), t(12), 1)], SRC)
    out = spark.createDataFrame([(0, t(9), t(10), t(13)), (0, t(9), t(10), t(1)), (1, t(9), t(10), t(11)), (2, t(9), t(10), None)], OUT)
    units = status.window_status(src, out)
    assert {(r["cam_id"], r["from_dt"].hour): r["status"] for r in units.collect()} == {(0, 9): "done", (1, 9): "stale", (2, 9): "done", (0, 10): "missing"}
    day = rollup.by_day(units).first()
    assert (day["total"], day["done"], day["pending"], day["pct"]) == (4, 2, 2, 50.0)
    # what the report calls pending is what the plan hands out
    plan = planning.plan_windows(status.pending_units(units), 2).collect()
    assert sum(r["n"] for r in plan) == 2
    assert rollup.by_day(status.window_status(src, out.limit(0))).first()["done"] == 0
    assert status.window_status(src.limit(0), out).count() == 0


def test_detect_stub_done_missing(spark):
    vid = spark.createDataFrame([(0, t(9, m), t(9, m + 4)) for m in (0, 5, 10)], "cam_id int, starttime timestamp_ntz, endtime timestamp_ntz")
    src = spark.createDataFrame([(0, t(9, 0), t(9, 4), t(12), 0), (0, t(9, 5, 0.5), t(9, 8), t(12), 10), (1, t(9, 10), t(9, 14), t(12), 10)], SRC)
    got = {r["starttime"].minute: (r["status"], r["expected"]) for r in status.detect_status(vid, src).collect()}
    assert {k: v[0] for k, v in got.items()} == {0: "zero_byte_stub", 5: "done", 10: "missing"}
    assert got[5][1].endswith("--2026-07-01T09_08_00Z.bbb")  # the name as found, though its end differs
    assert status.undetected_videos(vid, src).count() == 2 == status.pending_units(status.detect_status(vid, src)).count()
    assert status.detect_status(vid, src, ["20260702"]).count() == 0
    assert status.detect_status(vid, src.drop("file_size").withColumn("is_valid", F.lit(None).cast("boolean"))).where("status = 'done'").count() == 0


def test_rollup_rules(spark):
    u = spark.createDataFrame([("20260701", "done"), ("20260701", "pending"), ("20260701", "skipped_no_txt"), ("20260702", "skipped_no_txt"), (None, "missing")], "day string, status string")
    assert {r["day"]: r["pct"] for r in rollup.by_day(u).collect()} == {"20260701": 50.0, "20260702": 100.0, None: 0.0}
    assert rollup.stage_totals(u.limit(0)).first()["pct"] is None
    assert rollup.pending_days(u).first()["days"] == ["20260701"]


def test_frames_and_backgrounds(spark):
    v = spark.createDataFrame([("20260701", c, c < 2) for c in (0, 1, 2)], "day string, cam_id int, has_txt boolean")
    f = spark.createDataFrame([("20260701", 0)], "day string, cam_id int")
    assert {r["cam_id"]: r["status"] for r in status.frame_status(v, f).collect()} == {0: "done", 1: "pending", 2: "skipped_no_txt"}
    frames = spark.createDataFrame([(c, f"x_20260701T09{m:02}00.png") for c in (0, 1) for m in range(0, 50, 10)] + [(3, "x_20260701T090000.png")], "cam_id int, file_name string")
    cams = spark.createDataFrame([("20260701", c) for c in (0, 1, 2, 3)], "day string, cam_id int")
    done = spark.createDataFrame([("20260701", 0, "background_20260701T090000.000000.000Z.png")], "day string, cam_id int, name string")
    got = {r["cam_id"]: r["status"] for r in status.background_status(cams, frames, done, 600, "hour").collect()}
    assert got == {0: "done", 1: "pending", 2: "skipped_no_frames", 3: "skipped_min_frames"}


def test_tag_resolution(spark):
    g = spark.createDataFrame([(i, "a") for i in range(4)], "u int, guess string")
    e = spark.createDataFrame([(0, "a"), (0, "b"), (1, "b"), (2, "b"), (2, "c")], "u int, tag string")
    assert {r["u"]: (r["tag"], r["note"]) for r in status.resolve_tag(g, e, ["u"]).collect()} == {0: ("a", ""), 1: ("b", "only other tag"), 2: ("a", "several tags"), 3: ("a", "")}


def test_greedy_overlap_keeps_the_last_kept_end(spark):
    f = spark.createDataFrame([(1, t(0), t(5)), (2, t(1), t(9)), (3, t(5), t(6)), (4, t(5, 30), t(7))], "event_id long, starttime timestamp_ntz, endtime timestamp_ntz").withColumn("cam", F.lit(0))
    assert {r["event_id"]: r["flagged"] for r in audit.overlapping_containers(f, ["cam"]).collect()} == {1: False, 2: True, 3: False, 4: True}


def test_bucket_edges_and_short_outputs(spark):
    files = spark.createDataFrame([("a", t(22, 19, 13), t(22, 20, 13), 5), ("b", t(1), t(2), 0), ("c", t(3), t(1), 5)], "name string, from_ts timestamp_ntz, to_ts timestamp_ntz, size long")
    there = spark.createDataFrame([("a", t(22), 5), ("a", t(22, 20), 0)], "name string, bucket timestamp_ntz, size long")
    assert {tuple(r) for r in audit.missing_bucket_copies(files, there).collect()} == {("a", t(22, 20)), ("c", t(3))}
    nominal = spark.createDataFrame([("a", t(1)), ("b", t(1)), ("c", None), ("d", t(1))], "file string, nominal_end timestamp_ntz")
    points = spark.createDataFrame([("a", t(0, 55)), ("b", t(0, 54, 59)), ("c", t(0))], "file string, ts timestamp_ntz")
    assert {r["file"]: r["valid"] for r in audit.short_outputs(nominal, points).collect()} == {"a": True, "b": False, "c": True, "d": False}


def test_chunks_of_empty_and_full_tables(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    assert [r["items"] for r in planning.chunk(df, [F.col("k")], 4, "k").orderBy("chunk_id").collect()] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]
    assert planning.chunk(df.limit(0), [F.col("k")], 4, "k").count() == 0
    sizes = [r["count"] for r in planning.split_even(df, [F.col("k")], 4).groupBy("worker").count().orderBy("worker").collect()]
    assert sizes == [3, 3, 2, 2]
    assert planning.split_even(df.limit(2), [F.col("k")], 4).select("worker").distinct().count() == 2


def test_steps_and_ranks(spark):
    tasks = spark.createDataFrame([(1, 5.0, 7.0), (2, 5.0, 7.0), (3, 5.0, 7.0)], "jobid long, own_rss double, own_cpu double")
    steps = spark.createDataFrame([(1, "batch", 10.0, 3.0), (1, "extern", 99.0, 1.0), (2, "extern", 4.0, 1.0)], "jobid long, step string, maxrss_kib double, totalcpu_s double")
    got = {r["jobid"]: (r["maxrss_kib"], r["totalcpu_s"]) for r in accounting.merge_steps(tasks, steps).collect()}
    assert got == {1: (10.0, 3.0), 2: (5.0, 7.0), 3: (5.0, 7.0)}
    nums = spark.createDataFrame([("a", i) for i in range(1, 101)], "k string, v int")
    assert accounting.nearest_rank(nums, "k", "v", {"a0": 0, "a5": 0.5, "a95": 0.95}).first()[1:] == (1, 50, 95)


def test_errors_are_kept_with_their_rows(spark, tmp_path):
    done = detections.map_with_errors(spark.createDataFrame([("1",), ("x",)], "v string"), int, "v")
    assert {(r["v"], r["result"]) for r in done.collect()} == {("1", "1"), ("x", None)}
    assert detections.failures(done).first()["error"].startswith("ValueError")
    (tmp_path / "good").write_bytes(b"ok")
    (tmp_path / "empty").write_bytes(b"")
    paths = spark.createDataFrame([(str(tmp_path / n),) for n in ("good", "empty", "gone")], "path string")
    assert {r["path"].rsplit("/", 1)[1]: r["valid"] for r in detections.validate_files(paths, lambda b: b == b"ok").collect()} == {"good": True, "empty": False, "gone": False}


@pytest.mark.parametrize("slice_rows", [7, 1_000_000])
def test_slices_carry_what_comes_before(spark, slice_rows):
    rnd = random.Random(slice_rows)
    rows = [(s % 2, s, t(0, 0, rnd.randrange(50)) if rnd.random() < 0.9 else None, rnd.randrange(5)) for s in range(100)]
    df = spark.createDataFrame(rows, "cam int, seq long, frame_ts timestamp_ntz, frame_id long")
    kept, number = set(), {}
    for cam in (0, 1):
        most, last, n = None, None, 0
        for _, s, ts, i in (r for r in rows if r[0] == cam):
            n += last is not None and i < last
            last, number[s] = i, n
            if most is None or (ts is not None and ts > most):
                kept.add(s)
                most = ts if ts is not None else most
    assert {r["seq"] for r in audit.monotonic_frames(df, ["cam"], slice_rows=slice_rows).collect()} == kept
    assert {r["seq"]: r["container"] for r in audit.split_containers(df, ["cam"], slice_rows=slice_rows).collect()} == number


def test_folds_of_large_groups_and_null_ends(spark):
    rnd = random.Random(3)
    rows = [(c, i, t(0, 0, rnd.randrange(5000)), t(0, 0, rnd.randrange(5000)) if rnd.random() < 0.9 else None) for c in (0, 1, None) for i in range(300)]
    got = {(r["cam"], r["event_id"]): r["flagged"] for r in audit.overlapping_containers(spark.createDataFrame(rows, "cam int, event_id long, starttime timestamp_ntz, endtime timestamp_ntz"), ["cam"]).collect()}
    for cam in (0, 1, None):
        last = None
        for _, i, s, e in sorted((r for r in rows if r[0] == cam), key=lambda r: (r[2], r[1])):
            flagged = last is not None and s < last
            assert got[cam, i] == flagged
            last = last if flagged else e


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("hours", [1, 7, 24])
def test_windows_of_given_days_equal_a_theta_join(spark, hours, seed):
    rnd = random.Random(seed)
    base = dt.datetime(2026, 6, 28)
    when = lambda: base + dt.timedelta(hours=rnd.randrange(200), minutes=rnd.choice([0, 0, 13]))
    rows = [(rnd.choice([1, 2, None]), s, s + dt.timedelta(minutes=rnd.choice([0, 20, 60, 500, 5000, -30, 60 * 24 * 3650])) if rnd.random() < 0.9 else None, when(), 1) for s in (when() for _ in range(60))]
    days = ["20260701", "20260702", "20270101", "19691231"]
    src, asked = spark.createDataFrame(rows, SRC), spark.createDataFrame([(d,) for d in [*days, None, days[0]]], "day string")
    expected = {}
    for day in days:
        midnight = dt.datetime.strptime(day, "%Y%m%d")
        for h in range(0, 24, hours):
            a, b = midnight + dt.timedelta(hours=h), min(midnight + dt.timedelta(hours=h + hours), midnight + dt.timedelta(days=1))
            for cam, s, e, m, _ in rows:
                if cam is not None and e is not None and s <= e and s < b and e > a:
                    expected[cam, a, b] = max(m, expected.get((cam, a, b), m))
    got = windows.window_units(src, hours, asked).collect()
    assert {(r["cam_id"], r["from_dt"], r["to_dt"]): r["latest_src_mtime"] for r in got} == expected and len(got) == len(expected)


def test_a_wrong_end_costs_tens_of_rows(spark):
    span = spark.range(1).select(windows.window_span(F.lit("2026-07-01 10:30:00").cast("timestamp_ntz"), F.lit("2036-07-01 10:30:00").cast("timestamp_ntz")).alias("s"))
    r = span.select("s.lo", "s.hi", windows.tree_nodes(F.col("s.lo"), F.col("s.hi")).alias("n")).first()
    covered = sorted(x for n in r["n"] for x in range(n["node"] << n["level"], (n["node"] + 1) << n["level"]))
    assert len(r["n"]) <= 34 and covered == list(range(r["lo"], r["hi"] + 1)) and len(covered) > 87_000


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("minutes", [20, 25])
def test_missing_buckets_are_a_difference_of_ranges(spark, seed, minutes):
    rnd = random.Random(seed)
    buckets = [t(h, m) for h in range(6) for m in range(0, 60, minutes)]
    of = lambda x: x.replace(minute=x.minute // minutes * minutes, second=0, microsecond=0)
    files = [(rnd.choice("abc"), s, s + dt.timedelta(minutes=rnd.choice([-5, 0, 7, 90, 200])) if rnd.random() < 0.9 else None, rnd.choice([0, 1, None, 5])) for s in (t(rnd.random() * 4) for _ in range(8))]
    there = [(rnd.choice("abc"), rnd.choice(buckets), rnd.choice([0, 3, 3])) for _ in range(25)]
    f, x = spark.createDataFrame(files, "name string, from_ts timestamp_ntz, to_ts timestamp_ntz, size long"), spark.createDataFrame(there, "name string, bucket timestamp_ntz, size long")
    wide = [t(h, m) for h in range(-1, 12) for m in range(0, 60, minutes)]
    expected = {(n, b) for n, s, e, size in files if size for b in wide if of(s) <= b <= of(max(s, e) if e else s)} - {(n, b) for n, b, size in there if size}
    got = audit.missing_bucket_copies(f, x, minutes).collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)
    ranges = audit.missing_bucket_ranges(f, x, minutes).collect()
    assert sum(r["n_buckets"] for r in ranges) == len(expected)
    apart = {(r["name"], r["first_bucket"]) for r in ranges}
    before = lambda b: max(w for w in wide if w < b)
    assert apart == {(n, b) for n, b in expected if (n, before(b)) not in expected}


def test_a_wrong_end_is_one_missing_range(spark):
    f = spark.createDataFrame([("a", t(0), t(0) + dt.timedelta(days=3650), 1)], "name string, from_ts timestamp_ntz, to_ts timestamp_ntz, size long")
    r = audit.missing_bucket_ranges(f, spark.createDataFrame([("a", t(0), 1)], "name string, bucket timestamp_ntz, size long")).collect()
    assert [(x["first_bucket"], x["n_buckets"]) for x in r] == [(t(0, 20), 3650 * 72)]


@pytest.mark.parametrize("cell_points", [2, 10**6])
def test_links_equal_brute_force_at_edges(spark, cell_points):
    rnd = random.Random(cell_points)
    rows = [(i, rnd.choice([1, 1, 2]), t(0, 0, rnd.choice([0, 1, 2, 4, 5, 8]) + rnd.choice([0, 0.5])), float(rnd.choice([-10, 0, 9, 10, 19, 20, 21, 40])), float(rnd.choice([0, 10, 20, 30]))) for i in range(150)]
    rows += [(900, 1, None, 1.0, 1.0), (901, 1, t(0), None, 1.0), (902, None, t(0), 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, cam_id int, ts timestamp_ntz, x double, y double")
    got = sorted((r["a"], r["b"]) for r in detections.link_candidates(df, speed=2.5, gap=4.0, cell_points=cell_points).collect())
    expected = []
    for i, cam, a, x, y in rows[:150]:
        for j, cam2, b, x2, y2 in rows[:150]:
            gap = (b - a).total_seconds()
            if cam == cam2 and 0 < gap <= 4 and math.hypot(x - x2, y - y2) <= 2.5 * gap:
                expected.append((i, j))
    assert got == sorted(expected) and len(got) > 50


def test_links_of_full_cells_are_many_tasks(spark):
    """Few bytes, many pairs: 16,000 points in 8 cells, two seconds each, far apart but for every hundredth."""
    ids = spark.range(16_000)
    df = ids.select("id", (F.col("id") % 8).alias("cam_id"), F.timestamp_seconds(F.lit(1_800_000_000) + F.col("id") % 2000 * 0.001).alias("ts"), (F.floor(F.col("id") / 8) * 1000 % 5_000).cast("double").alias("x"), (F.col("id") * 7919 % 8009).cast("double").alias("y"))
    large = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}  # as on larger tables
    for k, v in large.items():
        spark.conf.set(k, v)
    try:
        links = detections.link_candidates(df, speed=2_500.0, gap=4.0)
        per_task = [r["count"] for r in links.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    finally:
        for k in large:
            spark.conf.unset(k)
    assert len(per_task) >= 3 and max(per_task) < 0.7 * sum(per_task)


def shuffled_rows(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_points_among_many_cells_are_shuffled_a_few_times(spark):
    """40,000 points in 20 x 20 cells of place and 10 of time, all of them taken: each went to 18 cells as an earlier point."""
    ids = spark.range(40_000)
    df = ids.select("id", (F.col("id") % 1).alias("cam_id"), F.timestamp_seconds(F.lit(1_800_000_000) + F.col("id") % 10 * 4 + F.col("id") % 7 * 0.5).alias("ts"), (F.floor(F.col("id") / 10) % 20 * 10.0 + F.col("id") % 9).alias("x"), (F.floor(F.col("id") / 200) % 20 * 10.0 + F.col("id") % 8).alias("y"))
    before = shuffled_rows(spark)
    n = detections.link_candidates(df, speed=2.5, gap=4.0).agg(F.count(F.lit(1)), F.sum("a"), F.sum("b"), F.sum("dt"), F.sum("dist")).first()[0]
    assert shuffled_rows(spark) - before < 5 * 40_000
    rows = df.select("id", F.unix_micros("ts").alias("us"), "x", "y").toPandas()
    us, x, y = (rows[c].to_numpy() for c in ("us", "x", "y"))
    expected = 0
    for at in range(0, len(us), 500):
        part = slice(at, at + 500)
        dt_s = (us[None, :] - us[part, None]) / 1e6
        expected += int(((dt_s > 0) & (dt_s <= 4) & ((x[None, :] - x[part, None]) ** 2 + (y[None, :] - y[part, None]) ** 2 <= (2.5 * dt_s) ** 2)).sum())
    assert n == expected > 100_000


def walk(rows):
    """Kept rows of one sorted group: (value, threshold or None) in order."""
    kept, last = [], None
    for value, threshold in rows:
        keep = last is None or value >= last
        kept.append(keep)
        if keep:
            last = threshold
    return kept


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("slice_rows", [3, 10**6])
def test_greedy_choices_equal_a_walk(spark, seed, slice_rows):
    rnd = random.Random(seed)
    rows, expected = [], {}
    for group in range(4):
        n = rnd.choice([1, 2, 40])
        values = [rnd.randrange(60) for _ in range(n)]
        if seed % 2:
            values.sort()
        made = [(v, None if rnd.random() < 0.1 else v + rnd.choice([-3, 0, 1, 4, 4, 25])) for v in values]
        if seed % 2 == 0:  # as in subsampling: the same step for all, values in any order
            made = [(v, v + 7) for v in values]
        for i, keep in enumerate(walk(made)):
            expected[group, i] = keep
        rows += [(group, i, v, x) for i, (v, x) in enumerate(made)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g long, i long, v long, x long").repartition(3)
    got = folds.keep_greedily(df, ["g"], ["i"], F.col("v"), F.col("x"), slice_rows)
    assert {(r["g"], r["i"]): r["_kept"] for r in got.collect()} == expected


def test_a_hot_day_is_many_tasks(spark):
    df = spark.range(20_000).select(F.lit(1).alias("cam"), F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 10).cast("timestamp_ntz").alias("starttime"), F.timestamp_seconds(F.col("id") * 10 + F.pmod(F.xxhash64("id"), F.lit(70))).cast("timestamp_ntz").alias("endtime"))
    done = audit.overlapping_containers(df, ["cam"], slice_rows=2_000).withColumn("task", F.spark_partition_id())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small tasks are not put together
    try:
        tasks = [r["count"] for r in done.groupBy("task").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(tasks) == 20_000 and len(tasks) > 2 and max(tasks) < 12_000
    rows = [(r["event_id"] * 10, int(r["endtime"].replace(tzinfo=dt.timezone.utc).timestamp())) for r in df.orderBy("event_id").collect()]
    kept = [i for i, keep in enumerate(walk(rows)) if keep]
    assert sorted(r["event_id"] for r in done.where("not flagged").collect()) == kept


@pytest.mark.parametrize("slice_rows", [2, 100])
def test_backward_time_across_slices(spark, slice_rows):
    rows = [("up", i, i) for i in range(9)] + [("edge", i, t) for i, t in enumerate([1, 2, 2, 3])] + [("inside", i, t) for i, t in enumerate([1, 0, 5, 6])] + [("one", 0, 1), ("none", 0, None), ("none", 1, None)]
    got = audit.backward_time(spark.createDataFrame(rows, "path string, seq long, ts long"), ["path"], slice_rows=slice_rows)
    assert {r["path"]: r["has_backward"] for r in got.collect()} == {"up": False, "edge": True, "inside": True, "one": False, "none": False}


def test_ranks_of_groups_over_several_partitions(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice(["a", "b", None]), rnd.randrange(40), None if rnd.random() < 0.3 else rnd.random()) for _ in range(500)] + [("c", None, None)]
    got = {r["g"]: r for r in accounting._ranks(spark.createDataFrame(rows, "g string, x int, y double").repartition(5), "g", ["x", "y"], {"p5": 0.05, "p50": 0.5, "max": 1.0}).collect()}
    assert set(got) == {"a", "b", "c", None}
    for g, r in got.items():
        for c, k in (("x", 1), ("y", 2)):
            values = sorted(row[k] for row in rows if row[0] == g and row[k] is not None)
            for n, q in (("p5", 0.05), ("p50", 0.5), ("max", 1.0)):
                assert r[f"{c}_{n}"] == (values[max(0, math.ceil(q * len(values)) - 1)] if values else None)


def test_entry_works_without_the_training_data_subpackage(tmp_path):
    """A copy without trackledger/llm and tests/llm lists all other queries."""
    root = pathlib.Path(__file__).resolve().parents[1]
    shutil.copytree(root / "trackledger", tmp_path / "trackledger", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for with_pipeline in (True, False):
        shutil.copy(root / "__spark_entry__.py", tmp_path)
        if with_pipeline and (root / "corpus_pipeline.py").exists():
            shutil.copy(root / "corpus_pipeline.py", tmp_path)
        else:
            (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
        code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), any(k.startswith('op') and k[2:3].isdigit() or k == 'pipeline' for k in q))"
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True)
        assert done.stdout.split() == [str(len(own.QUERIES)), "False"]
