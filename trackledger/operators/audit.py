"""Faults in the data: backward time, overlaps, copies, missing and short files; and ordered folds over a camera's day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackledger.functions.names import bucket_start, day_of
from trackledger.operators.folds import SLICE_ROWS, keep_greedily


def backward_time(points: DataFrame, path: list[str], seq: str = "seq", ts: str = "ts", slice_rows: int = 1_000_000) -> DataFrame:
    """(path, has_backward): whether any time in a file is not after the one before it.

    A file's points are compared in slices of ``seq``; of each slice the first and last time are held against its neighbours'.
    """
    w = Window.partitionBy(*path, "_slice").orderBy(seq)
    back = _sliced(points, seq, slice_rows).select(*path, "_slice", seq, ts, (F.col(ts) <= F.lag(ts).over(w)).alias("_back"))
    ends = back.groupBy(*path, "_slice").agg(F.coalesce(F.bool_or("_back"), F.lit(False)).alias("_back"), F.min_by(ts, seq).alias("_first"), F.max_by(ts, seq).alias("_last"))
    edge = F.coalesce(F.col("_first") <= F.lag("_last").over(Window.partitionBy(*path).orderBy("_slice")), F.lit(False))
    return ends.select(*path, (F.col("_back") | edge).alias("_back")).groupBy(*path).agg(F.bool_or("_back").alias("has_backward"))


def container_stats(points: DataFrame, path: list[str], seq: str = "seq", ts: str = "ts") -> DataFrame:
    """(path, first_ts, last_ts, n_frames) in the order of ``seq``; one pass, no sort."""
    return points.groupBy(*path).agg(F.min_by(ts, seq).alias("first_ts"), F.max_by(ts, seq).alias("last_ts"), F.count(F.lit(1)).alias("n_frames"))


def _micros(t: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), t.cast("timestamp_ntz"))


def overlapping_containers(files: DataFrame, by: list[str], start: str = "starttime", end: str = "endtime", key: str = "event_id", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(by, key, start, end, flagged): a file that starts before the last *kept* file of its group has ended is flagged.

    A flagged file doesn't move the end, so a running maximum of ends would flag too much. Files without a start are left out; after a kept
    file without an end the next one is kept.
    """
    rows = files.where(F.col(start).isNotNull()).select(*by, key, start, end)
    done = keep_greedily(rows, by, [start, key], _micros(F.col(start)), _micros(F.col(end)), slice_rows)
    return done.withColumn("flagged", ~F.col("_kept")).drop("_kept")


def subsample_frames(frames: DataFrame, by: list[str], ts: str, name: str, seconds: int, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Frames at least ``seconds`` after the last kept one of their group, by name; those without a time are dropped."""
    if seconds <= 0:
        raise ValueError("the interval is a positive number of seconds")
    rows = frames.where(F.col(ts).isNotNull()).select(*by, name, ts)
    at = _micros(F.col(ts))
    return keep_greedily(rows, by, [name, ts], at, at + int(seconds * 1_000_000), slice_rows).where("_kept").drop("_kept")


def duplicate_copies(files: DataFrame, name: list[str], from_ts: str = "from_ts", bucket: str = "bucket_ts", path: str = "path") -> DataFrame:
    """``files`` with n_copies and flagged: of the copies of a name the one in the bucket of its start stays, else the first by path."""
    canonical = bucket_start(F.col(from_ts)) == bucket_start(F.col(bucket))
    w = Window.partitionBy(*name)
    place = F.row_number().over(w.orderBy(F.when(canonical, 0).otherwise(1), path))
    return files.withColumns({"n_copies": F.count(F.lit(1)).over(w), "flagged": place > 1})


def _bucket_number(t: Column, minutes: int) -> Column:
    """Buckets before ``t``, counted in each hour as ``bucket_start`` does, through all hours."""
    hour = F.timestamp_diff("HOUR", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.date_trunc("hour", t).cast("timestamp_ntz"))
    return (hour * -(-60 // minutes) + F.floor(F.minute(t) / minutes)).cast("long")


def _bucket_time(number: Column, minutes: int) -> Column:
    n = -(-60 // minutes)
    hour = F.timestamp_add("HOUR", F.floor(number / n).cast("int"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.timestamp_add("MINUTE", (F.pmod(number, F.lit(n)) * minutes).cast("int"), hour)


def missing_bucket_ranges(files: DataFrame, existing: DataFrame, minutes: int = 20) -> DataFrame:
    """(name, first_bucket, last_bucket, n_buckets): runs of buckets between a file's start and end that hold no copy of it, or an empty one.

    ``files`` has name, from_ts, to_ts, size (empty ones ask for nothing); ``existing`` has name, bucket, size. Asked ranges and buckets
    with copies are swept as edges, so a file costs two rows however long it is; a wrong end of years is one run.
    """
    number = lambda c: _bucket_number(F.col(c) if isinstance(c, str) else c, minutes)
    asked = files.where("size > 0").select("name", number("from_ts").alias("lo"), number(F.greatest("from_ts", "to_ts")).alias("hi")).where("lo is not null")
    there = existing.where("size > 0").select("name", number("bucket").alias("lo")).where("lo is not null").distinct()
    edge = lambda at, a, t: F.struct(at.alias("at"), F.lit(a).alias("asked"), F.lit(t).alias("there"))
    edges = asked.select("name", F.inline(F.array(edge(F.col("lo"), 1, 0), edge(F.col("hi") + 1, -1, 0)))).unionByName(there.select("name", F.inline(F.array(edge(F.col("lo"), 0, 1), edge(F.col("lo") + 1, 0, -1)))))
    edges = edges.groupBy("name", "at").agg(F.sum("asked").alias("asked"), F.sum("there").alias("there"))
    w = Window.partitionBy("name").orderBy("at")
    run = edges.select("name", "at", F.lead("at").over(w).alias("until"), F.sum("asked").over(w).alias("asked"), F.sum("there").over(w).alias("there"))
    gaps = run.where("asked > 0 and there = 0").select("name", "at", "until")
    # neighbouring gaps are one
    new = F.coalesce((F.col("at") > F.lag("until").over(w)).cast("int"), F.lit(0))
    whole = gaps.withColumn("g", new).withColumn("g", F.sum("g").over(w)).groupBy("name", "g").agg(F.min("at").alias("lo"), F.max("until").alias("hi"))
    return whole.select("name", _bucket_time(F.col("lo"), minutes).alias("first_bucket"), _bucket_time(F.col("hi") - 1, minutes).alias("last_bucket"), (F.col("hi") - F.col("lo")).alias("n_buckets"))


def missing_bucket_copies(files: DataFrame, existing: DataFrame, minutes: int = 20) -> DataFrame:
    """(name, bucket): each bucket of ``missing_bucket_ranges`` by itself."""
    ranges = missing_bucket_ranges(files, existing, minutes)
    number = F.explode(F.sequence(_bucket_number(F.col("first_bucket"), minutes), _bucket_number(F.col("last_bucket"), minutes)))
    return ranges.select("name", number.alias("k")).select("name", _bucket_time(F.col("k"), minutes).alias("bucket"))


def long_files(files: DataFrame, minutes: int = 20, most_steps: int = 200) -> DataFrame:
    """(name, buckets): files that span more than ``most_steps`` buckets (a wrong end time, as a rule), and how many."""
    span = _bucket_number(F.greatest("from_ts", "to_ts"), minutes) - _bucket_number(F.col("from_ts"), minutes) + 1
    return files.where("size > 0").select("name", span.alias("buckets")).where(F.col("buckets") > most_steps)


def reconcile_listings(source: DataFrame, dest: DataFrame, exts: tuple[str, ...] | None = None) -> DataFrame:
    """(rel, source_size, dest_size, status): match, size_differs, only_source or only_dest; of files with these endings (in any case), if given."""
    if exts is not None:
        fits = F.lit(False)
        for e in exts:
            fits = fits | F.lower(F.col("rel").cast("string")).endswith(e.lower())
        source, dest = source.where(fits), dest.where(fits)
    both = source.select("rel", F.col("size").alias("source_size")).join(dest.select("rel", F.col("size").alias("dest_size")), "rel", "full_outer")
    status = F.when(F.col("source_size").isNull(), "only_dest").when(F.col("dest_size").isNull(), "only_source").when(F.col("source_size") == F.col("dest_size"), "match").otherwise("size_differs")
    return both.withColumn("status", status)


def reconcile_verdicts(classes: DataFrame) -> DataFrame:
    """One row: whether all common files agree, and whether the trees are equal."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return classes.agg((n("size_differs") == 0).alias("common_agree"), (n("size_differs", "only_source", "only_dest") == 0).alias("equal"))


def short_outputs(files: DataFrame, points: DataFrame, gap_seconds: float = 300.0) -> DataFrame:
    """(file, last_ts, valid): a file without points, or whose last point lies more than the gap before its nominal end, is not valid."""
    last = points.groupBy("file").agg(F.max("ts").alias("last_ts"))
    late = F.timestamp_diff("MICROSECOND", F.col("last_ts"), F.col("nominal_end")) > F.lit(int(gap_seconds * 1_000_000))
    valid = F.when(F.col("last_ts").isNull(), False).when(F.col("nominal_end").isNull(), True).otherwise(~late)
    return files.join(last, "file", "left").select("file", "last_ts", valid.alias("valid"))


def audit_totals(flags: DataFrame) -> DataFrame:
    """(day, files, flagged, kept) per day, and over all days where day is null."""
    return flags.rollup("day").agg(F.count(F.lit(1)).alias("files"), F.count_if("flagged").alias("flagged"), F.count_if(~F.col("flagged")).alias("kept"))


def stray_dirs(paths: DataFrame, path: str = "path") -> DataFrame:
    """(dir): first parts of paths that are not numbers."""
    return paths.select(F.substring_index(path, "/", 1).alias("dir")).where(~F.col("dir").rlike("^[0-9]+$")).distinct()


#: Numbers of ``seq`` that lie together in one task; each slice of a group passes one row on to the next.
SLICE = 1_000_000


def _sliced(frames: DataFrame, seq: str, slice_rows: int) -> DataFrame:
    return frames.withColumn("_slice", F.floor(F.col(seq) / slice_rows))


def monotonic_frames(frames: DataFrame, by: list[str], seq: str = "seq", ts: str = "frame_ts", slice_rows: int = SLICE) -> DataFrame:
    """Frames later than all before them: a dropped frame never raises the maximum, so this equals dropping as they come.

    A camera's history is cut into slices by ``seq``; what is carried on is each slice's maximum.
    """
    sliced = _sliced(frames, seq, slice_rows)
    most = sliced.groupBy(*by, "_slice").agg(F.max(ts).alias("_max"))
    before = most.select(*by, "_slice", F.max("_max").over(Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    inside = F.max(ts).over(Window.partitionBy(*by, "_slice").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1))
    joined = sliced.withColumn("_inside", inside).join(before, [*by, "_slice"]).withColumn("_most", F.greatest("_inside", "_before"))
    return joined.where(F.col("_most").isNull() | (F.col(ts) > F.col("_most"))).select(*frames.columns)


def split_containers(frames: DataFrame, by: list[str], seq: str = "seq", frame_id: str = "frame_id", slice_rows: int = SLICE) -> DataFrame:
    """``frames`` with container: its number in the camera, one more whenever the frame's number falls.

    A slice of ``seq`` knows its own falls; the last number and the count of falls of those before it are carried on.
    """
    w = Window.partitionBy(*by, "_slice").orderBy(seq)
    inside = _sliced(frames, seq, slice_rows).withColumn("_new", F.coalesce((F.col(frame_id) < F.lag(frame_id).over(w)).cast("long"), F.lit(0)))
    ends = inside.groupBy(*by, "_slice").agg(F.min_by(frame_id, seq).alias("_first"), F.max_by(frame_id, seq).alias("_last"), F.sum("_new").alias("_falls"))
    over = Window.partitionBy(*by).orderBy("_slice")
    falls = F.coalesce((F.col("_first") < F.lag("_last").over(over)).cast("long"), F.lit(0))
    ends = ends.withColumn("_edge", falls).withColumn("_before", F.sum(F.col("_edge") + F.col("_falls")).over(over.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_falls"))
    inside = inside.withColumn("_own", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return inside.join(ends.select(*by, "_slice", "_before"), [*by, "_slice"]).select(*frames.columns, (F.col("_before") + F.col("_own")).alias("container"))


def dedup_containers(containers: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first container of every key."""
    w = Window.partitionBy(*key).orderBy(order)
    return containers.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def flag_overlaps_after_copies(files: DataFrame) -> DataFrame:
    """Overlaps among files that are not flagged copies, by camera and day."""
    return overlapping_containers(files.where(~F.col("flagged")).withColumn("day", day_of(F.col("from_ts"))), ["day", "cam_id"], "from_ts", "to_ts")
