"""What is done: a status for every unit of work."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackledger.functions.names import build_name, config_tag, day_of, frame_day, frame_time, start_key, time_bucket
from trackledger.operators.audit import subsample_frames
from trackledger.operators.windows import filter_days, window_units
from trackledger.sources.listing import read_catalog

# Classes of statuses.
PENDING = ("missing", "stale", "pending", "zero_byte_stub")
SKIPPED = ("skipped_no_txt", "skipped_no_frames", "skipped_min_frames")
# End of fixed values.


def pending_units(units: DataFrame) -> DataFrame:
    return units.where(F.col("status").isin(*PENDING))


def good_source(columns: list[str]) -> Column:
    """Whether a catalog row counts as an output: is_valid if it is there, else a size above 0, else always."""
    if "is_valid" in columns:
        return F.coalesce(F.col("is_valid"), F.lit(False))
    return F.coalesce(F.col("file_size"), F.lit(0)) > 0 if "file_size" in columns else F.lit(True)


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("key", start_key(F.col("cam_id"), F.col("starttime")))


def undetected_videos(videos: DataFrame, sources: DataFrame) -> DataFrame:
    """Videos without a good output of the same camera and start second."""
    done = _keyed(sources.where(good_source(sources.columns))).where("key is not null").select("key").distinct()
    return _keyed(videos).join(done, "key", "left_anti").drop("key")


def detect_status(videos: DataFrame, sources: DataFrame, days: list[str] | None = None) -> DataFrame:
    """``videos`` with day, expected (the output's name: as found, else as predicted) and status: done, zero_byte_stub or missing."""
    rows = _keyed(videos.withColumn("day", day_of(F.col("starttime"))))
    name = F.col("file_name") if "file_name" in sources.columns else build_name(F.col("cam_id"), F.col("starttime"), F.col("endtime"))
    found = _keyed(sources).where("key is not null").groupBy("key").agg(F.bool_or(good_source(sources.columns)).alias("good"), F.max(F.struct(good_source(sources.columns).alias("g"), name.alias("n")))["n"].alias("found"))
    out = filter_days(rows, days).join(found, "key", "left")
    status = F.when(F.col("good"), "done").when(F.col("good").isNotNull(), "zero_byte_stub").otherwise("missing")
    return out.withColumns({"expected": F.coalesce("found", build_name(F.col("cam_id"), F.col("starttime"), F.col("endtime"))), "status": status}).drop("key", "good", "found")


def window_status(sources: DataFrame, outputs: DataFrame, days: list[str] | None = None, hours: int = 1) -> DataFrame:
    """(day, cam_id, from_dt, to_dt, latest_src_mtime, out_mtime, status): done, stale or missing for every window with recordings.

    Of several outputs of one window the newest counts; a null time on either side is not stale.
    """
    units = filter_days(window_units(sources, hours).withColumn("day", day_of(F.col("from_dt"))), days)
    out = outputs.groupBy("cam_id", "from_dt", "to_dt").agg(F.max("modified_time").alias("out_mtime"), F.lit(True).alias("there"))
    status = F.when(F.col("there").isNull(), "missing").when(F.col("latest_src_mtime") > F.col("out_mtime"), "stale").otherwise("done")
    return units.join(out, ["cam_id", "from_dt", "to_dt"], "left").select("day", "cam_id", "from_dt", "to_dt", "latest_src_mtime", "out_mtime", status.alias("status"))


def all_expected_present(expected: DataFrame, existing: DataFrame, unit: list[str], name: str = "name") -> DataFrame:
    """(unit, present): whether every expected name of a unit exists. Units that expect nothing don't appear: they are not done."""
    there = existing.select(*unit, name).distinct().withColumn("there", F.lit(1))
    return expected.select(*unit, name).distinct().join(there, [*unit, name], "left").groupBy(*unit).agg((F.count(F.lit(1)) == F.count("there")).alias("present"))


def frame_sources(videos: DataFrame, texts: DataFrame) -> DataFrame:
    """Videos that have a text beside them, by stem."""
    return videos.join(texts.select("stem").distinct(), "stem", "left_semi")


def frame_status(videos: DataFrame, frames: DataFrame) -> DataFrame:
    """(day, cam_id, n_videos, status) from videos (day, cam_id, has_txt) and frames (day, cam_id) on disk."""
    units = videos.groupBy("day", "cam_id").agg(F.count(F.lit(1)).alias("n_videos"), F.bool_or("has_txt").alias("txt"))
    there = frames.select("day", "cam_id").distinct().withColumn("there", F.lit(True))
    status = F.when(~F.col("txt"), "skipped_no_txt").when(F.col("there"), "done").otherwise("pending")
    return units.join(there, ["day", "cam_id"], "left").select("day", "cam_id", "n_videos", status.alias("status"))


def expected_backgrounds(frames: DataFrame, interval: int | None, window: str | int) -> DataFrame:
    """(day, cam_id, name): the background of every window that holds a kept frame; frames have day, cam_id, file_name."""
    timed = frames.withColumn("ts", frame_time(F.col("file_name"))).where("ts is not null")
    kept = subsample_frames(timed, ["day", "cam_id"], "ts", "file_name", interval) if interval else timed
    name = F.concat(F.lit("background_"), F.date_format(time_bucket(F.col("ts"), window), "yyyyMMdd'T'HHmmss"), F.lit(".000000.000Z.png"))
    return kept.select("day", "cam_id", name.alias("name")).distinct()


def background_units(frames: DataFrame, cams: list[int] | None = None, interval: int | None = None, label: str | None = None) -> DataFrame:
    """(day, cam_id, n_frames, kept): frames of each camera and day (from their names), and how many the interval keeps.

    With ``label`` the frames are one source of that name, whatever their days: it stands in ``day``.
    """
    named = frames.withColumn("day", frame_day(F.col("file_name")) if label is None else F.lit(label))
    if cams is not None:
        named = named.where(F.col("cam_id").isin(cams))
    total = named.groupBy("day", "cam_id").agg(F.count(F.lit(1)).alias("n_frames"))
    timed = named.withColumn("ts", frame_time(F.col("file_name"))).where("ts is not null")
    kept = (subsample_frames(timed, ["day", "cam_id"], "ts", "file_name", interval) if interval else timed).groupBy("day", "cam_id").agg(F.count(F.lit(1)).alias("kept"))
    return total.join(kept, ["day", "cam_id"], "left").select("day", "cam_id", "n_frames", F.coalesce("kept", F.lit(0)).alias("kept"))


def background_status(cameras: DataFrame, frames: DataFrame, existing: DataFrame, interval: int | None, window: str | int | None, min_frames: int = 3) -> DataFrame:
    """(day, cam_id, n_frames, tag, status) for every (day, cam_id) of ``cameras``; ``existing`` has day, cam_id and name.

    Without a window (count mode) any background is enough.
    """
    units = cameras.select("day", "cam_id").distinct().join(background_units(frames, interval=interval), ["day", "cam_id"], "left")
    named = frames.withColumn("day", frame_day(F.col("file_name")))
    if window is None:
        done = existing.where(F.col("name").rlike(r"^background_.*\.png$")).select("day", "cam_id").distinct().withColumn("present", F.lit(True))
    else:
        done = all_expected_present(expected_backgrounds(named, interval, window), existing, ["day", "cam_id"])
    tag = config_tag(F.lit(interval).cast("int"), F.lit(None if window is None else str(window)).cast("string"), F.lit(10), F.lit(200))
    n, few = F.coalesce("n_frames", F.lit(0)), F.lit(window is not None) & (F.coalesce("kept", F.lit(0)) < min_frames)
    status = F.when(n == 0, "skipped_no_frames").when(few, "skipped_min_frames").when(F.coalesce("present", F.lit(False)), "done").otherwise("pending")
    return units.join(done, ["day", "cam_id"], "left").select("day", "cam_id", n.cast("long").alias("n_frames"), tag.alias("tag"), status.alias("status"))


def resolve_tag(guess: DataFrame, existing: DataFrame, unit: list[str]) -> DataFrame:
    """(unit, tag, note): the guessed tag if it is there; else the only other one; else the guess, noted where there are several."""
    there = existing.groupBy(*unit).agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    joined = guess.join(there, unit, "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    alone = F.size("tags") == 1
    known = F.array_contains("tags", F.col("guess"))
    return joined.select(*unit, F.when(known | ~alone, F.col("guess")).otherwise(F.try_element_at("tags", F.lit(1))).alias("tag"), F.when(known | (F.size("tags") == 0), "").when(alone, "only other tag").otherwise("several tags").alias("note"))


def sidecar_status(catalog: DataFrame, contrast: bool = True) -> DataFrame:
    """``catalog`` (detections_clahe, detections_noclahe) with done or missing for the contrast mode."""
    flag = F.col("detections_clahe" if contrast else "detections_noclahe")
    return catalog.withColumn("status", F.when(F.coalesce(flag, F.lit(False)), "done").otherwise("missing"))


def progress_report(stages: dict[str, DataFrame | str | None]) -> DataFrame:
    """(stage, day, status, reason) of all stages; one without a catalog has one row without day, status unavailable.

    Such a stage is given as None, or as the text that says why; every other row has no reason.
    """
    spark = next((u.sparkSession for u in stages.values() if isinstance(u, DataFrame)), None)
    if spark is None:
        raise ValueError("no stages")
    missing = [(name, None, "unavailable", why or "no catalog") for name, why in stages.items() if not isinstance(why, DataFrame)]
    parts = [u.select(F.lit(name).alias("stage"), F.col("day").cast("string").alias("day"), "status", F.lit(None).cast("string").alias("reason")) for name, u in stages.items() if isinstance(u, DataFrame)]
    return reduce(DataFrame.unionByName, [*parts, spark.createDataFrame(missing, "stage string, day string, status string, reason string")])


def available(spark: SparkSession, catalog: str, units: Callable[[DataFrame], DataFrame]) -> DataFrame | str:
    """Units of a stage made from its catalog (``refresh_catalog``), or why there are none."""
    try:
        return units(read_catalog(spark, catalog))
    except FileNotFoundError as e:
        return f"catalog unavailable: {e}"
