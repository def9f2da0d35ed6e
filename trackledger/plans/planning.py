"""Which pending units go out next: order, cap, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackledger.functions.names import prefix_route, recorder_camera, recorder_time
from trackledger.sources.shared import written


def not_queued(units: DataFrame, queue: DataFrame, key: str) -> DataFrame:
    """Units that no queue holds yet."""
    return units.join(queue.select(key).distinct(), key, "left_anti")


def number_rows(df: DataFrame, order: list[Column], name: str = "rn") -> DataFrame:
    """Global row numbers from 1 without one task that holds all rows.

    The rows are range-partitioned by the order; each partition is numbered by itself, behind the sizes of those before it. The
    ranges come from a sample, so the partitioned rows are written once: sizes and rows must see the same ranges.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    local = ranged.withColumn("_at", F.col("_at") - F.shiftleft(F.col("_part").cast("long"), 33))
    local = written(local)
    sizes = local.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each partition
    return local.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def chunk(df: DataFrame, order: list[Column], size: int, item: str) -> DataFrame:
    """(chunk_id, n, items): rows in order, ``size`` to a chunk."""
    return _chunks(number_rows(df, order), size, item, [])


def _chunks(numbered: DataFrame, size: int, item: str, by: list[str]) -> DataFrame:
    of = F.floor((F.col("rn") - 1) / size)
    items = F.transform(F.array_sort(F.collect_list(F.struct("rn", F.col(item).alias("item")))), lambda x: x["item"])
    return numbered.withColumn("chunk_id", of).groupBy(*by, "chunk_id").agg(F.count(F.lit(1)).alias("n"), items.alias("items"))


def _capped(df: DataFrame, order: list[Column], size: int, most_jobs: int | None) -> DataFrame:
    return df if most_jobs is None else df.orderBy(*order).limit(size * most_jobs)


def plan_detect(pending: DataFrame, size: int, most_jobs: int | None = None, item: str = "file_name") -> DataFrame:
    """Chunks of pending videos (file_name, cam_id, starttime): capped in the order of paths, then cut in that of time, camera, path."""
    return chunk(_capped(pending, [F.col(item)], size, most_jobs), [F.col("starttime"), F.col("cam_id"), F.col(item)], size, item)


def plan_windows(pending: DataFrame, size: int, most_jobs: int | None = None) -> DataFrame:
    """Chunks of pending windows (cam_id, from_dt, to_dt), capped and cut in the order of time and camera."""
    order = [F.col("from_dt"), F.col("cam_id")]
    item = F.concat_ws("|", F.col("cam_id").cast("string"), F.date_format("from_dt", "yyyy-MM-dd'T'HH:mm:ss"), F.date_format("to_dt", "yyyy-MM-dd'T'HH:mm:ss"))
    return chunk(_capped(pending, order, size, most_jobs).withColumn("item", item), order, size, "item")


def plan_sidecars(files: DataFrame, rules: list[tuple[str, str]], size: int, most_jobs: int | None = None) -> DataFrame:
    """(model, chunk_id, n, items) of pending recorder files (file_name, mtime), oldest first, capped for each model."""
    f = files.withColumns({"model": prefix_route(recorder_camera(F.col("file_name")), rules), "ts": recorder_time(F.col("file_name"), F.col("mtime"))})
    numbered = number_rows(f, [F.col("model"), F.col("ts"), F.col("file_name")])
    first = numbered.groupBy("model").agg(F.min("rn").alias("_first"))  # a row for each model
    numbered = numbered.join(F.broadcast(first), "model").withColumn("rn", F.col("rn") - F.col("_first") + 1).drop("_first")
    if most_jobs is not None:
        numbered = numbered.where(F.col("rn") <= size * most_jobs)
    return _chunks(numbered, size, "file_name", ["model"])


def split_even(df: DataFrame, order: list[Column], workers: int) -> DataFrame:
    """``df`` with worker 1 to ``workers``: parts in order, sizes at most one apart."""
    n = df.agg(F.count(F.lit(1)).alias("_all"))
    rows = number_rows(df, order).join(F.broadcast(n))  # one row
    small, more = F.floor(F.col("_all") / workers), F.col("_all") % workers
    edge = (small + 1) * more
    worker = F.when(F.col("rn") <= edge, F.floor((F.col("rn") - 1) / (small + 1))).otherwise(more + F.floor((F.col("rn") - 1 - edge) / F.greatest(small, F.lit(1)))) + 1
    return rows.withColumn("worker", worker).drop("rn", "_all")


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """(chunks, items, avg_items): of a plan."""
    return chunks.agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.size("items")).alias("items"), F.avg(F.size("items")).alias("avg_items"))


def new_ids(before: DataFrame, after: DataFrame, column: str = "id") -> DataFrame:
    """(id, place): ids that are new in ``after``, numbers in order first, then texts."""
    new = after.select(column).exceptAll(before.select(column)).distinct()
    return number_rows(new, [F.col(column).try_cast("long").asc_nulls_last(), F.col(column)], "place")


def remaining_days(days: DataFrame, submitted: DataFrame) -> DataFrame:
    """Days not handed out yet."""
    return days.join(submitted.select("day").distinct(), "day", "left_anti")


def encode_work(units: DataFrame, columns: list[str]) -> DataFrame:
    """(line): each unit as a JSON line, times in ISO form with Z."""
    return units.select(F.to_json(F.struct(*columns), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"}).alias("line"))


def decode_work(lines: DataFrame, column: str = "line") -> DataFrame:
    """(cam_id, from_dt, to_dt) of JSON lines; a time may end in Z or not, and is UTC."""
    j = F.from_json(column, "cam_id int, from_dt string, to_dt string")
    when = lambda c: F.replace(F.regexp_replace(c, "Z$", ""), F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz")
    return lines.select(j.alias("j")).select("j.cam_id", when(F.col("j.from_dt")).alias("from_dt"), when(F.col("j.to_dt")).alias("to_dt"))
