"""File listings by tasks (empty files are kept), and catalogs made of listings."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackledger.functions.names import day_of, day_of_path, parse_name, stem
from trackledger.sources.shared import written
from trackledger.sources.versions import Versioned

LISTING = "top string, path string, file_name string, mtime timestamp, size long"
VISITED = "dir string, mtime_ns long, open boolean"
#: Folders that the driver, or a task for each folder it is given, looks into before it hands the rest on.
HEAD, BUDGET = 64, 1_000
#: A folder that changed in these last nanoseconds is looked at again the next time; more than one tick of the file system's clock.
SETTLE_NS = 20_000_000


def _visit(root: str, start: str, most: int) -> Iterator[tuple[str, int | None, bool]]:
    """(dir, time in nanoseconds, False) of ``start`` and folders below it, ``most`` at most; the others met are given back open."""
    todo, seen = [start], 0
    while todo:
        d = todo.pop()
        if seen >= most:
            yield d, None, True
            continue
        seen += 1
        try:
            ns = os.stat(os.path.join(root, d)).st_mtime_ns  # before its entries are read: what comes in later shows the next time
            with os.scandir(os.path.join(root, d)) as entries:
                todo += sorted((f"{d}/{e.name}" if d else e.name for e in entries if e.is_dir(follow_symlinks=False)), reverse=True)
        except OSError:
            continue  # it went away meanwhile
        # the clock of a file system ticks: what comes in within the same tick would not show, so a time as new as that is not kept as it is
        yield d, ns if time.time_ns() - ns > SETTLE_NS else ns - 1, False


def directories(spark: SparkSession, root: str, head: int = HEAD, budget: int = BUDGET) -> DataFrame:
    """(dir, mtime_ns) of all folders under ``root`` (itself as ''), at any depth; no file is looked at.

    The driver looks into ``head`` folders. Those left are dealt to tasks, which look into ``budget`` folders for each one given and hand
    on what is still left, so that neither a day of many folders nor a deep tree is one task. A missing ``root`` is an error.
    """
    os.stat(root)
    first = list(_visit(root, "", head))
    found = spark.createDataFrame(first, VISITED)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d in batch.column("dir").to_pylist():
                rows = list(_visit(root, d, budget))
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.bool_()), strict=True)], ["dir", "mtime_ns", "open"])

    done, todo = [found.where("not open")], found.where("open")
    more = any(o for _, _, o in first)
    while more:
        step = written(todo.select("dir").repartition(_tasks(spark), "dir").mapInArrow(go, VISITED))
        done.append(step.where("not open"))
        todo = step.where("open")
        more = not todo.isEmpty()
    return reduce(DataFrame.union, done).select("dir", "mtime_ns")


def _tasks(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def files_in(dirs: DataFrame, root: str) -> DataFrame:
    """(dir, top, path, file_name, mtime, size) of the files that lie in these folders themselves; folders are dealt to tasks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["dir", "top", "path", "file_name", "mtime", "size"], [pa.string()] * 4 + [pa.timestamp("us", "UTC"), pa.int64()]
        for batch in batches:
            for d in batch.column("dir").to_pylist():
                for rows in _runs(_files(root, d), 10_000):
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return dirs.select("dir").repartition(_tasks(dirs.sparkSession), "dir").mapInArrow(read, f"dir string, {LISTING}")


def _files(root: str, d: str) -> Iterator[tuple]:
    try:
        with os.scandir(os.path.join(root, d)) as entries:
            for e in entries:
                try:
                    if not e.is_dir(follow_symlinks=False):
                        s = e.stat()
                        yield d, d.split("/")[0], f"{d}/{e.name}" if d else e.name, e.name, s.st_mtime_ns // 1000, s.st_size
                except OSError:
                    continue  # it went away meanwhile
    except OSError:
        return


def _runs(rows: Iterator[tuple], size: int) -> Iterator[list[tuple]]:
    while run := list(islice(rows, size)):
        yield run


def read_listing(spark: SparkSession, root: str, tops: list[str] | None = None) -> DataFrame:
    """(top, path, file_name, mtime, size) of all files under ``root``, or under some of its first-level folders."""
    dirs = directories(spark, root)
    if tops is not None:
        dirs = dirs.where(F.substring_index("dir", "/", 1).isin(tops))
    return files_in(dirs, root).drop("dir")


def latest_mtime_by_day(listing: DataFrame, day: str = "day", mtime: str = "mtime") -> DataFrame:
    """(day, latest_mtime)."""
    return listing.groupBy(day).agg(F.max(mtime).alias("latest_mtime"))


def stale_days(now: DataFrame, manifest: DataFrame, force_recent: int = 0) -> DataFrame:
    """Days (day, latest_mtime) that have changed since the manifest, and the newest ``force_recent`` days in any case."""
    changed = now.join(manifest.select("day", F.col("latest_mtime").alias("seen")), "day", "left").where(F.col("seen").isNull() | (F.col("latest_mtime") > F.col("seen"))).select("day")
    if not force_recent:
        return changed
    return changed.union(now.select("day").orderBy(F.desc("day")).limit(force_recent)).distinct()


def video_catalog(listing: DataFrame, exts: tuple[str, ...] = (".mp4",)) -> DataFrame:
    """``listing`` of these extensions (in any case) with cam_id, starttime, endtime; names of another form keep nulls."""
    fits = F.lit(False)
    for e in exts:
        fits = fits | F.lower("file_name").endswith(e.lower())
    return listing.where(fits).withColumn("_p", parse_name(F.col("file_name"))).select("*", "_p.*").drop("_p")


def output_catalog(listing: DataFrame) -> DataFrame:
    """(cam_id, from_dt, to_dt, modified_time) from the names of produced files; other names are left out."""
    p = listing.withColumn("_p", parse_name(F.col("file_name")))
    return p.where("_p.cam_id is not null and _p.starttime is not null").select("_p.cam_id", F.col("_p.starttime").alias("from_dt"), F.col("_p.endtime").alias("to_dt"), F.col("mtime").alias("modified_time"))


def sidecar_catalog(listing: DataFrame, ext: str = ".h264", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, file_name, detections_clahe, detections_noclahe): which recordings have a detections file of either model beside them."""
    name = F.col("file_name")
    side = r"^(.*)-detections(?:-polo)?-(c|nc)\.parquet$"
    rows = listing.select(*by, F.when(name.endswith(ext), stem(name)).otherwise(F.regexp_extract(name, side, 1)).alias("stem"), name.endswith(ext).alias("video"), F.regexp_extract(name, side, 2).alias("kind"), name.alias("file_name"))
    found = rows.where("video or kind <> ''").groupBy(*by, "stem").agg(F.max(F.when(F.col("video"), F.col("file_name"))).alias("file_name"), F.bool_or(F.col("kind") == "c").alias("detections_clahe"), F.bool_or(F.col("kind") == "nc").alias("detections_noclahe"))
    return found.where("file_name is not null").drop("stem")


def frame_inventory(listing: DataFrame) -> DataFrame:
    """(day, cam_id, names, n): the frames on disk of each day and camera."""
    return listing.groupBy("day", "cam_id").agg(F.array_sort(F.collect_set("file_name")).alias("names"), F.count(F.lit(1)).alias("n"))


def files_of_day(listing: DataFrame, day: str, pattern: str = r"\.(bbb|mp4)$") -> DataFrame:
    """Files whose start lies on ``day`` and whose name fits; names that begin with a dot or end in ``.tmp`` are left out."""
    p = listing.withColumn("_s", parse_name(F.col("file_name"))["starttime"])
    return p.where((day_of(F.col("_s")) == day) & F.col("file_name").rlike(pattern) & ~F.col("file_name").rlike(r"^\.|\.tmp$")).drop("_s")


def valid_basic(size: Column) -> Column:
    """A file that is there and not empty."""
    return F.coalesce(size, F.lit(0)) > 0


def union_days(parts: list[DataFrame]) -> DataFrame:
    """Daily catalogs as one; columns that some lack are null there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


Check = Callable[[DataFrame], DataFrame]


def read_catalog(spark: SparkSession, catalog: str, where: Column | str | None = None, version: int | None = None) -> DataFrame:
    """The catalog's rows, of one version (the newest); ``where`` is a condition on ``day`` by which folders are chosen."""
    table = Versioned(spark, catalog)
    return table.read("shaped" if "shaped" in table.described(version)["schemas"] else "files", where, version)


def refresh_catalog(spark: SparkSession, root: str, catalog: str, force_recent: int = 0, full: bool = False, by_files: bool = False, deep: Check | None = None, shape: Check | None = None) -> list[str]:
    """Bring the catalog at ``catalog`` up to date with the files under ``root``; returns the days whose rows were replaced.

    Days are folders ``YYYYMMDD`` or ``YYYY-MM-DD``, or ``YYYY/MM/DD`` in three levels; what lies below them may be nested at will. A folder
    is listed again if its time is another than the one kept for it, or if it is new; files of other folders are not looked at, their rows are
    carried on. Folders and days that are gone lose their rows, and a day without files is an empty day. A file that grows in place does not
    change its folder: list the newest days again with ``force_recent``, or compare files' times and sizes (``by_files``, a full walk).

    Rows have is_valid: a file is not empty; with ``deep`` (listing with a ``full_path`` -> with a boolean ``valid``, as ``validate_files`` gives)
    its content is read, and folders that were checked less deeply are stale. ``shape`` turns a day's listing into other rows that keep ``day``
    (``sidecar_catalog`` with ``by=("day",)``). Rows and times become current in one commit: until then, and if the refresh dies, readers
    see the version before. Times are taken before files are listed, so what comes in meanwhile is found the next time.
    """
    table = Versioned(spark, catalog)
    base = table.current()
    now = written(directories(spark, root).withColumn("day", day_of_path(F.col("dir"))).where("day is not null"))
    nothing = spark.createDataFrame([], "day string, dir string, mtime_ns long, deep boolean")
    seen = table.read("directories", version=base) if base else nothing
    both = now.join(seen.select("dir", F.col("day").alias("_day"), F.col("mtime_ns").alias("_ns"), "deep"), "dir", "full_outer")
    stale = F.col("_ns").isNull() | (F.col("mtime_ns") != F.col("_ns")) | F.lit(full)
    if deep:
        stale = stale | ~F.coalesce("deep", F.lit(False))
    if force_recent:
        recent = [r["day"] for r in now.select("day").distinct().orderBy(F.desc("day")).limit(force_recent).collect()]
        stale = stale | F.col("day").isin(recent)
    kind = F.when(F.col("mtime_ns").isNull(), "gone").when(stale, "stale").otherwise("same")
    state = both.select("dir", F.coalesce("day", "_day").alias("day"), "mtime_ns", F.coalesce("deep", F.lit(False)).alias("deep"), kind.alias("kind"))
    if by_files:
        sums = lambda df, n: df.groupBy("dir").agg(F.struct(F.count(F.lit(1)), F.max("mtime"), F.sum("size")).alias(n))
        here, kept = sums(files_in(now, root), "_here"), sums(table.read("files", version=base), "_kept") if base else None
        if kept is not None:
            state = state.join(here, "dir", "left").join(kept, "dir", "left").withColumn("kind", F.when((F.col("kind") == "same") & ~F.col("_here").eqNullSafe(F.col("_kept")), "stale").otherwise(F.col("kind"))).drop("_here", "_kept")
    state = written(state)
    days = sorted(r["day"] for r in state.where("kind <> 'same'").select("day").distinct().collect())  # a name for each day
    if not days and base:
        return days
    touched = state.where(F.col("day").isin(days))
    rows = files_in(touched.where("kind = 'stale'"), root).withColumns({"day": day_of_path(F.col("dir")), "is_valid": valid_basic(F.col("size"))})
    if deep:
        rows = deep(rows.withColumn("full_path", F.concat(F.lit(f"{root}/"), "path"))).withColumn("is_valid", F.col("valid")).drop("valid", "full_path")
    rows = rows.select("day", "dir", "top", "path", "file_name", "mtime", "size", "is_valid")
    if base:
        carried = table.read("files", F.col("day").isin(days), base)
        rows = rows.unionByName(carried.join(touched.where("kind = 'same'").select("dir"), "dir", "left_semi"))
    rows = written(rows)  # files are looked at once
    checked = F.when(F.col("kind") == "stale", deep is not None).otherwise(F.col("deep"))
    tables = {"files": rows, "directories": touched.where("kind <> 'gone'").select("day", "dir", "mtime_ns", checked.alias("deep"))}
    if shape:
        tables["shaped"] = shape(rows)
    table.commit(tables, ["day"], touched.select("day"), base)
    return days


def newest_copy(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The newest row of every key."""
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


