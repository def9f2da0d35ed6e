"""Listings, incremental catalogs, snapshots, reports and feeds on a temporary tree."""

from __future__ import annotations

import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from trackledger.operators import detections
from trackledger.plans import status
from trackledger.sources import listing, shared, snapshots, versions
from trackledger.sources.versions import Versioned
from trackledger.streaming import feeds


def settle():
    """Folders that have only just changed are listed once more; wait until they count as settled."""
    time.sleep(0.05)


def tree(root, days=("20260701", "2026-07-02"), n=2):
    for d in days:
        for i in range(n):
            (root / d / "cam-0").mkdir(parents=True, exist_ok=True)
            (root / d / "cam-0" / f"cam-0_2026070{d[-1]}T09000{i}.000000Z--2026070{d[-1]}T09010{i}.000000Z.mp4").write_bytes(b"x" * i)
    settle()


def test_listing_keeps_empty_files(spark, tmp_path):
    tree(tmp_path)
    df = listing.read_listing(spark, str(tmp_path))
    assert df.count() == 4 and df.where("size = 0").count() == 2
    assert listing.read_listing(spark, str(tmp_path), ["20260701"]).count() == 2
    cat = listing.video_catalog(df)
    assert cat.where("cam_id = 0 and starttime is not null").count() == 4


def test_only_changed_days_are_listed_anew(spark, tmp_path):
    root, catalog = tmp_path / "videos", str(tmp_path / "catalog")
    tree(root)
    assert listing.refresh_catalog(spark, str(root), catalog) == ["20260701", "20260702"]
    assert listing.refresh_catalog(spark, str(root), catalog) == []
    time.sleep(0.05)
    (root / "20260701" / "cam-0" / "new.mp4").write_bytes(b"abc")
    assert listing.refresh_catalog(spark, str(root), catalog) == ["20260701"]
    assert listing.read_catalog(spark, catalog).count() == 5
    assert listing.refresh_catalog(spark, str(root), catalog, force_recent=2) == ["20260701", "20260702"]
    assert listing.refresh_catalog(spark, str(root), catalog, full=True) == ["20260701", "20260702"]


def test_snapshots_reports_and_history(spark, tmp_path):
    path = str(tmp_path / "snap")
    df = spark.range(3)
    snapshots.write_snapshot(df, path, "20260701")
    snapshots.write_snapshot(df.limit(1), path, "20260702")
    snapshots.write_snapshot(df.limit(2), path, "20260702")
    assert snapshots.read_snapshots(spark, path).count() == 5
    assert snapshots.latest_snapshot(snapshots.read_snapshots(spark, path)).count() == 2 == snapshots.read_latest_snapshot(spark, path).count()
    snapshots.write_snapshot(df.limit(0), path, "20260702")
    assert snapshots.read_snapshots(spark, path).count() == 3 and snapshots.read_latest_snapshot(spark, path).count() == 0
    units = spark.createDataFrame([("20260701", "done"), ("20260701", "missing")], "day string, status string")
    report = status.progress_report({"detect": units, "rpi": None})
    for at in ("2026-07-01T10:00:00", "2026-07-01T11:00:00"):
        snapshots.save_report(report, str(tmp_path / "rep"), at)
    loaded = snapshots.load_report(spark, str(tmp_path / "rep"))
    assert loaded["by_day"].where("stage = 'detect'").first()["pct"] == 50.0
    (tmp_path / "rep" / "history" / "other.json").write_text("{broken\n")
    hist = snapshots.read_history(spark, str(tmp_path / "rep" / "history"), ["detect"])
    assert {r["detect_pct"] for r in hist.collect()} == {50.0} and hist.count() == 2
    shaped = snapshots.conform(df, spark.createDataFrame([], "id string, more double").schema)
    assert shaped.dtypes == [("id", "string"), ("more", "double")] and shaped.first()["more"] is None
    snapshots.write_report(units.withColumn("a", F.array("day")), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_detections_of_nothing_still_leave_a_table(spark, tmp_path):
    df = spark.createDataFrame([], "timestamp timestamp_ntz, cam_id int, x double")
    snapshots.write_detections(df, str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d")).count() == 0


def test_detections_of_a_range_read_its_folders_only(spark, tmp_path):
    path = str(tmp_path / "d")
    rows = spark.range(4_000).select(F.expr("timestamp_ntz'2026-07-01 00:00:00' + make_dt_interval(0, 0, id)").alias("timestamp"), (F.col("id") % 3).cast("int").alias("cam_id"), F.col("id").alias("x"))
    snapshots.write_detections(rows, path)
    got = snapshots.read_detections(spark, path, 1, "2026-07-02 10:00:00", "2026-07-02 12:00:00")
    assert sorted(r["x"] for r in got.collect()) == [x for x in range(1440 + 600, 1440 + 720) if x % 3 == 1]
    plan = got._sc._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted")
    filters = next(line for line in plan.splitlines() if line.startswith("PartitionFilters"))
    assert "day" in filters and "cam_id" in filters
    got.foreach(lambda _: None)
    scans = got._jdf.queryExecution().executedPlan().collectLeaves()
    read = [scans.apply(i).metrics().apply("numFiles").value() for i in range(scans.size())]
    files = list((tmp_path / "d").rglob("*.parquet"))
    assert read and sum(read) <= len(list((tmp_path / "d" / "day=20260702" / "cam_id=1").iterdir())) < len(files) / 4


def test_a_stage_says_why_it_is_unavailable(spark, tmp_path):
    units = spark.createDataFrame([("20260701", "done")], "day string, status string")
    missing = status.available(spark, str(tmp_path / "no"), lambda rows: rows)
    rows = status.progress_report({"detect": units, "rpi": missing, "tracking": None}).collect()
    why = {r["stage"]: r["reason"] for r in rows}
    assert why["detect"] is None and why["rpi"].startswith("catalog unavailable") and why["tracking"] == "no catalog"
    tree(tmp_path / "videos")
    listing.refresh_catalog(spark, str(tmp_path / "videos"), str(tmp_path / "no"))
    assert status.available(spark, str(tmp_path / "no"), lambda rows: rows).count() == 4
    with pytest.raises(ValueError, match="no stages"):
        status.progress_report({"rpi": None})


def follow(spark, tmp_path):
    feeds.stream_changes(spark, str(tmp_path / "cat"), str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination()
    return sorted((r["change"], r["path"].split("/")[-1], r["version"]) for r in feeds.read_changes(spark, str(tmp_path / "out")).collect())


def test_changes_of_a_catalog_are_told_once(spark, tmp_path):
    root = tmp_path / "videos"
    tree(root, days=("20260701",))
    listing.refresh_catalog(spark, str(root), str(tmp_path / "cat"))
    first = follow(spark, tmp_path)
    assert [c for c, _, _ in first] == ["added", "added"]
    gone = next((root / "20260701" / "cam-0").iterdir())
    gone.unlink()
    (root / "20260701" / "late.mp4").write_bytes(b"abc")
    os.utime(root / "20260701" / "late.mp4", ns=(10**18, 10**18))  # copied with its old time
    listing.refresh_catalog(spark, str(root), str(tmp_path / "cat"))
    second = follow(spark, tmp_path)
    assert second == sorted([*first, ("removed", gone.name, 2), ("added", "late.mp4", 2)])
    assert follow(spark, tmp_path) == second
    # the batch that told version 2 runs again
    commits = tmp_path / "state" / "commits"
    last = max(int(p.name) for p in commits.iterdir() if p.name.isdigit())
    for p in (commits / str(last), commits / f".{last}.crc"):
        p.unlink(missing_ok=True)
    assert follow(spark, tmp_path) == second


def nested(root, days, hours=(8, 9), n=2):
    for d in days:
        for h in hours:
            folder = root / d[:4] / d[4:6] / d[6:] / f"{h:02d}" / "20"
            folder.mkdir(parents=True, exist_ok=True)
            for i in range(n):
                (folder / f"{i}.mp4").write_bytes(b"x")
    settle()


def paths(spark, catalog):
    return {r["path"] for r in listing.read_catalog(spark, catalog).collect()}


def test_catalog_of_a_nested_tree(spark, tmp_path, monkeypatch):
    root, catalog = tmp_path / "videos", str(tmp_path / "catalog")
    nested(root, ["20260701", "20260702", "20260703"])
    assert listing.refresh_catalog(spark, str(root), catalog) == ["20260701", "20260702", "20260703"]
    assert len(paths(spark, catalog)) == 12 and listing.refresh_catalog(spark, str(root), catalog) == []
    time.sleep(0.05)
    (root / "2026/07/02/09/20/new.mp4").write_bytes(b"abc")
    for f in (root / "2026/07/01").rglob("*.mp4"):
        f.unlink()
    shutil.rmtree(root / "2026/07/03")
    asked = []
    monkeypatch.setattr(listing, "files_in", lambda dirs, r, f=listing.files_in: asked.extend(x["dir"] for x in dirs.collect()) or f(dirs, r))
    assert listing.refresh_catalog(spark, str(root), catalog) == ["20260701", "20260702", "20260703"]
    assert sorted(asked) == ["2026/07/01/08/20", "2026/07/01/09/20", "2026/07/02/09/20"]  # only what changed, of the deepest folders
    assert paths(spark, catalog) == {f"2026/07/02/{h}/20/{i}.mp4" for h in ("08", "09") for i in (0, 1)} | {"2026/07/02/09/20/new.mp4"}
    marks = Versioned(spark, catalog).manifest().where("table = 'files' and stamp is null").collect()
    assert {r["day"] for r in marks} == {"20260701", "20260703"}
    assert listing.read_catalog(spark, catalog, "day = '20260702'").count() == 5


def test_a_refresh_that_dies_changes_nothing_for_readers(spark, tmp_path, monkeypatch):
    root, catalog = tmp_path / "videos", str(tmp_path / "catalog")
    nested(root, ["20260701", "20260702"])
    listing.refresh_catalog(spark, str(root), catalog)
    before = paths(spark, catalog)
    time.sleep(0.05)
    shutil.rmtree(root / "2026/07/01")
    nested(root, ["20260704"])
    monkeypatch.setattr(versions, "put_new", lambda *a: (_ for _ in ()).throw(RuntimeError("died")))
    with pytest.raises(RuntimeError, match="died"):
        listing.refresh_catalog(spark, str(root), catalog)
    monkeypatch.undo()
    assert paths(spark, catalog) == before
    (tmp_path / "catalog" / "commits" / "0000000002").write_text('{"version"')  # a marker that was begun
    assert paths(spark, catalog) == before
    reader = listing.read_catalog(spark, catalog)
    assert listing.refresh_catalog(spark, str(root), catalog) == ["20260701", "20260704"]
    assert {p[:10] for p in paths(spark, catalog)} == {"2026/07/02", "2026/07/04"}
    assert reader.count() == len(before)  # a reader keeps the version that it began with
    Versioned(spark, catalog).vacuum(keep=1)
    assert {p[:10] for p in paths(spark, catalog)} == {"2026/07/02", "2026/07/04"}
    kept = {p.parent.name for p in (tmp_path / "catalog" / "data" / "files").glob("*/_key=*")}
    assert len(kept) == 2  # of what died nothing is left
    with pytest.raises(FileNotFoundError):
        listing.refresh_catalog(spark, str(tmp_path / "unmounted"), catalog)


def test_two_writers_of_one_version(spark, tmp_path):
    shared.put_new(spark, str(tmp_path / "x" / "1"), "a")
    with pytest.raises(Exception, match="exists"):
        shared.put_new(spark, str(tmp_path / "x" / "1"), "b")
    assert shared.text_of(spark, str(tmp_path / "x" / "1")) == "a"
    table, rows = Versioned(spark, str(tmp_path / "t")), spark.createDataFrame([("a", 1)], "k string, v int")
    assert table.commit({"rows": rows}, ["k"], since=0) == 1
    with pytest.raises(RuntimeError, match="version 1"):
        table.commit({"rows": rows}, ["k"], since=0)  # made from what was there before
    assert table.current() == 1 and table.read("rows").collect() == rows.collect()
    with pytest.raises(ValueError, match="parted by"):
        table.commit({"rows": rows}, ["v"])
    with pytest.raises(KeyError):
        table.read("others")


def test_keys_of_any_kind_and_what_changed(spark, tmp_path):
    """Null and odd keys, repeated rows, a key that goes, and the rows that two versions don't share."""
    table = Versioned(spark, str(tmp_path / "t"))
    first = spark.createDataFrame([("a/b=c:%", 1, "x"), (None, 2, "y"), ("z", 3, None), ("z", 3, None)], "k string, id int, v string")
    table.commit({"rows": first}, ["k"])
    assert sorted(map(str, table.read("rows").collect())) == sorted(map(str, first.collect()))
    assert table.read("rows", "k is null").collect() == first.where("k is null").collect()
    table.commit({"rows": spark.createDataFrame([(None, 2, "other"), (None, 4, "n")], first.schema)}, ["k"], spark.createDataFrame([("a/b=c:%",)], "k string"))
    assert {(r["k"], r["id"], r["v"]) for r in table.read("rows").collect()} == {(None, 2, "other"), (None, 4, "n"), ("z", 3, None)}
    told = lambda since, until: {(r["change"], r["id"]) for r in table.changes("rows", ["id"], since, until).collect()}
    assert told(1, 2) == {("removed", 1), ("changed", 2), ("added", 4)} and told(2, 2) == set()
    assert told(0, 1) == {("added", 1), ("added", 2), ("added", 3)}
    assert table.read("rows", version=1).count() == 4


def test_a_day_of_many_folders_is_listed_by_many_tasks(spark, tmp_path):
    for h in range(300):
        (tmp_path / "20260701" / f"{h:03d}").mkdir(parents=True)
        (tmp_path / "20260701" / f"{h:03d}" / "a").write_bytes(b"")
    dirs = listing.directories(spark, str(tmp_path), head=5, budget=20)
    assert dirs.count() == 302 and dirs.distinct().count() == 302
    files = listing.files_in(dirs, str(tmp_path)).withColumn("task", F.spark_partition_id())
    assert files.count() == 300
    by_task = [r["count"] for r in files.groupBy("task").count().collect()]
    assert len(by_task) == listing._tasks(spark) and max(by_task) < 200


def test_refresh_looks_at_files_of_changed_folders_only(spark, tmp_path, monkeypatch):
    root, catalog = tmp_path / "videos", str(tmp_path / "catalog")
    tree(root, n=20)
    listing.refresh_catalog(spark, str(root), catalog)
    seen = []
    monkeypatch.setattr(listing.os, "stat", lambda p, stat=os.stat: seen.append(str(p)) or stat(p))
    list(listing._visit(str(root), "", 100))
    assert len(seen) == 5 and not any(p.endswith(".mp4") for p in seen)  # the root, and two folders a day
    monkeypatch.undo()
    time.sleep(0.05)
    late = root / "2026-07-02" / "cam-0" / "late.mp4"
    late.write_bytes(b"abc")
    os.utime(late, ns=(10**18, 10**18))
    settle()
    assert listing.refresh_catalog(spark, str(root), catalog) == ["20260702"]
    late.write_bytes(b"abcdef")  # grows in place
    assert listing.refresh_catalog(spark, str(root), catalog) == []
    assert listing.refresh_catalog(spark, str(root), catalog, by_files=True) == ["20260702"]
    assert listing.read_catalog(spark, catalog).where("size = 6 and file_name = 'late.mp4'").count() == 1
    assert listing.refresh_catalog(spark, str(root), catalog, by_files=True, full=True) == ["20260701", "20260702"]
    assert listing.read_catalog(spark, catalog).count() == 41


def test_reports_without_a_stage_read_so(spark, tmp_path):
    units = spark.createDataFrame([("20260701", "done")], "day string, status string")
    two = status.progress_report({"detect": units, "rpi": units})
    snapshots.save_report(two, str(tmp_path), "2026-07-01T10:00:00")
    snapshots.save_report(two.where("stage = 'detect'"), str(tmp_path), "2026-07-01T10:00:00")
    loaded = snapshots.load_report(spark, str(tmp_path))
    assert {r["stage"] for r in loaded["by_day"].collect()} == {"detect"} and loaded["units"].count() == 1
    assert snapshots.read_history(spark, str(tmp_path / "history"), ["detect", "rpi"]).count() == 1  # told again, kept once
    snapshots.save_report(two.limit(0), str(tmp_path), "2026-07-01T11:00:00")
    assert snapshots.load_report(spark, str(tmp_path))["units"].count() == 0
    assert snapshots.load_report(spark, str(tmp_path), "2026-07-01T10:00:00")["units"].count() == 1


def files_of(path, table):
    """Files with rows in the newest commit of a versioned folder's table."""
    newest = max((path / "data" / table).iterdir())
    return [f for f in newest.rglob("*.parquet") if f.stat().st_size > 0]


def test_a_report_of_one_time_is_not_one_task(spark, tmp_path):
    """All of its rows have one key and compress to nothing: tasks write them where they are, none takes them all."""
    units = spark.range(0, 40_000, 1, 4).select(F.lit("20260701").alias("day"), F.lit("done").alias("status"))
    snapshots.save_report(status.progress_report({"detect": units}), str(tmp_path), "2026-07-01T10:00:00")
    assert len(files_of(tmp_path / "tables", "units")) == 4
    loaded = snapshots.load_report(spark, str(tmp_path))
    assert loaded["units"].count() == 40_000 and [r["total"] for r in loaded["by_day"].collect()] == [40_000]
    assert {r["generated_at"] for r in loaded["summary"].collect()} == {"2026-07-01T10:00:00"}
    snapshots.write_snapshot(units, str(tmp_path / "snap"), "20260701")
    assert len(files_of(tmp_path / "snap", "rows")) == 4


def test_ledger_entries_are_kept_once(spark, tmp_path):
    path = str(tmp_path / "ledger")
    for run, days in (("0", ["a"]), ("1", ["b", "c"]), ("1", ["b", "c"]), ("2", [])):
        snapshots.append_ledger(spark.createDataFrame([(d,) for d in days], "day string"), path, run)
    assert sorted(r["day"] for r in snapshots.read_ledger(spark, path).collect()) == ["a", "b", "c"]
    snapshots.compact_ledger(spark, path)
    snapshots.append_ledger(spark.createDataFrame([("b",)], "day string"), path, "1")
    snapshots.append_ledger(spark.createDataFrame([("d",)], "day string"), path, "3")
    snapshots.compact_ledger(spark, path)
    assert sorted((r["day"], r["run"]) for r in snapshots.read_ledger(spark, path).collect()) == [("a", "0"), ("b", "1"), ("d", "3")]


def test_a_run_told_again_is_not_one_task(spark, tmp_path):
    path = str(tmp_path / "ledger")
    entries = spark.range(0, 40_000, 1, 4).select(F.lit("20260701").alias("day"))
    snapshots.append_ledger(entries, path, "0")
    assert len(files_of(tmp_path / "ledger", "entries")) == 4
    snapshots.append_ledger(entries.limit(10), path, "1")
    snapshots.compact_ledger(spark, path)
    snapshots.append_ledger(entries, path, "0")  # told again, beside what the compacted part holds of other runs
    assert len(files_of(tmp_path / "ledger", "entries")) >= 4
    assert {(r["run"], r["count"]) for r in snapshots.read_ledger(spark, path).groupBy("run").count().collect()} == {("0", 40_000), ("1", 10)}


def test_deeper_check_lists_days_again(spark, tmp_path):
    root, catalog = tmp_path / "videos", str(tmp_path / "catalog")
    tree(root, n=3)
    deep = lambda rows: detections.validate_files(rows, lambda data: data != b"x", "full_path")
    assert len(listing.refresh_catalog(spark, str(root), catalog)) == 2
    assert listing.read_catalog(spark, catalog).where("is_valid").count() == 4  # of each day one is empty
    assert len(listing.refresh_catalog(spark, str(root), catalog, deep=deep)) == 2
    assert listing.read_catalog(spark, catalog).where("is_valid").count() == 2
    assert listing.refresh_catalog(spark, str(root), catalog, deep=deep) == [] == listing.refresh_catalog(spark, str(root), catalog)


def test_sidecar_catalog_is_kept_up_to_date(spark, tmp_path):
    root, catalog = tmp_path / "rec", str(tmp_path / "catalog")
    for d in ("20260701", "20260702"):
        (root / d).mkdir(parents=True)
        (root / d / "a.h264").write_bytes(b"x")
    settle()
    shape = lambda rows: listing.sidecar_catalog(rows, by=("day",))
    listing.refresh_catalog(spark, str(root), catalog, shape=shape)
    time.sleep(0.05)
    (root / "20260702" / "a-detections-c.parquet").write_bytes(b"x")
    assert listing.refresh_catalog(spark, str(root), catalog, shape=shape) == ["20260702"]
    rows = listing.read_catalog(spark, catalog).collect()
    assert {(str(r["day"]), r["detections_clahe"]) for r in rows} == {("20260701", False), ("20260702", True)}


def test_a_late_batch_that_runs_again_is_written_once(spark, tmp_path):
    now, late = str(tmp_path / "now"), str(tmp_path / "late")
    first = spark.sql("SELECT id, timestamp'2026-07-01 00:00:00' + make_dt_interval(id) AS ts FROM range(10)")
    second = spark.sql("SELECT id + 100 AS id, timestamp'2026-07-01 00:00:00' + make_dt_interval(id) AS ts FROM range(12)")
    for i, batch in ((0, first), (1, second), (1, second)):
        feeds.stream_late(spark, batch, i, now, late, days=4)
    assert spark.read.parquet(now).count() == 5 + 5 and spark.read.parquet(late).count() == 5 + 7


def test_work_folders_are_shared_folders():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="all nodes share"):
        shared.scratch(Session())
