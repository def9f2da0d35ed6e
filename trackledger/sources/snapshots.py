"""Catalogs, reports and ledgers on disk."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trackledger.operators.detections import in_range
from trackledger.operators.rollup import by_day, stage_summary
from trackledger.sources.shared import written
from trackledger.sources.versions import Versioned

HISTORY = "generated_at string, stages map<string, struct<pct: double, pending: bigint>>"
LEDGER = "ts string, jobname string, dates array<string>, job_ids array<string>, source string"


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """The declared columns in their types; those that are not there are null, others are left out."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def write_snapshot(df: DataFrame, path: str, snapshot: str) -> None:
    """Write one dated snapshot; writing it again replaces it and no other, also by nothing."""
    Versioned(df.sparkSession, path).commit({"rows": df}, ["snapshot"], key=(snapshot,))


def read_snapshots(spark: SparkSession, path: str, where: Column | str | None = None) -> DataFrame:
    """Rows of all snapshots, or of those that a condition on ``snapshot`` chooses; folders of others are not read."""
    return Versioned(spark, path).read("rows", where)


def read_latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the newest snapshot, which may be empty. Only the manifest's names are looked at to find it."""
    table = Versioned(spark, path)
    newest = table.manifest().where(F.col("table") == "rows").agg(F.max("snapshot")).first()[0]
    return table.read("rows", F.col("snapshot") == newest)


def latest_snapshot(df: DataFrame, snapshot: str = "snapshot") -> DataFrame:
    """Rows of the newest snapshot of a table that holds several."""
    return df.join(F.broadcast(df.agg(F.max(snapshot).alias(snapshot))), snapshot, "left_semi")  # one row


def write_report(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays are joined by blanks."""
    flat = [F.array_join(c, " ").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def append_history(summary: DataFrame, path: str, generated_at: str) -> None:
    """Append one line with every stage's share and pending units; a line of the same time is replaced, so a replay adds nothing."""
    stage = F.struct(F.col("pct"), F.col("pending"))
    line = summary.where("stage is not null").agg(F.map_from_entries(F.collect_list(F.struct("stage", stage))).alias("stages")).select(F.lit(generated_at).alias("generated_at"), "stages")
    line.coalesce(1).write.mode("overwrite").json(f"{path}/at={re.sub('[^0-9A-Za-z-]', '_', generated_at)}")


def load_history(lines: DataFrame, stages: list[str], column: str = "line") -> DataFrame:
    """(generated_at, <stage>_pct, <stage>_pending) of JSON lines; lines that can't be read are skipped."""
    j = lines.select(F.from_json(column, HISTORY, {"mode": "PERMISSIVE"}).alias("j")).where("j.generated_at is not null").select("j.*")
    out = [c for s in stages for c in (F.col("stages")[s]["pct"].alias(f"{s}_pct"), F.col("stages")[s]["pending"].alias(f"{s}_pending"))]
    return j.select("generated_at", *out)


def read_history(spark: SparkSession, path: str, stages: list[str]) -> DataFrame:
    return load_history(spark.read.option("recursiveFileLookup", True).text(path).withColumnRenamed("value", "line"), stages)


REPORT = ("units", "by_day", "summary")


def save_report(report: DataFrame, path: str, generated_at: str) -> None:
    """Units, days and summary of one report in one commit, and its line of history; saved again, it replaces what was there, stages left out too."""
    tables = {"units": report, "by_day": by_day(report, "stage"), "summary": stage_summary(report)}
    Versioned(report.sparkSession, f"{path}/tables").commit(tables, ["generated_at"], key=(generated_at,))
    append_history(stage_summary(report), f"{path}/history", generated_at)


def load_report(spark: SparkSession, path: str, generated_at: str | None = None) -> dict[str, DataFrame]:
    """The tables of the report of that time, or of the newest."""
    saved = Versioned(spark, f"{path}/tables")
    at = generated_at or saved.manifest().agg(F.max("generated_at")).first()[0]
    return {name: saved.read(name, F.col("generated_at") == at) for name in REPORT}


def append_ledger(df: DataFrame, path: str, run: str) -> None:
    """Add a run's (or batch's) entries; a run that is told again replaces its own entries, also where they were compacted meanwhile."""
    table, spark = Versioned(spark=df.sparkSession, path=path), df.sparkSession
    rows = df.withColumn("run", F.lit(run))
    if table.current():
        held = table.read("runs").where(F.col("run") == run).select("part").distinct().collect()  # one row
        if held:
            part = held[0]["part"]
            same = table.read("entries", F.col("part") == part).where(F.col("run") != run).drop("part")
            known = table.read("runs", F.col("part") == part)
            table.commit({"entries": same.unionByName(rows), "runs": known}, ["part"], key=(part,))
            return
    table.commit({"entries": rows, "runs": spark.createDataFrame([(run,)], "run string")}, ["part"], key=(run,))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All entries, with the run that told them."""
    return Versioned(spark, path).read("entries").drop("part")


def compact_ledger(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Put the entries of all runs into one part and delete what the newest ``keep`` versions don't need; every run stays known."""
    table = Versioned(spark, path)
    parts = table.manifest().select("part").distinct()
    both = {name: table.read(name) for name in ("entries", "runs")}
    table.commit(both, ["part"], written(parts), key=("compacted",))
    table.vacuum(keep)


def recent_submissions(ledger: DataFrame, names: list[str] | None = None, last: int = 20) -> DataFrame:
    """The last entries by time, of some job names if given; arrays as text."""
    rows = ledger if names is None else ledger.where(F.col("jobname").isin(names))
    return rows.orderBy(F.desc("ts"), F.desc("jobname")).limit(last).withColumns({"dates": F.array_join("dates", " "), "job_ids": F.array_join("job_ids", " ")})


def write_detections(df: DataFrame, path: str) -> None:
    """Detections (timestamp, cam_id, ...) by day and camera, each file a range of times; an empty table still leaves a readable one."""
    out = df.withColumn("day", F.date_format("timestamp", "yyyyMMdd"))
    if out.isEmpty():
        out.limit(0).write.mode("append").parquet(path)
        return
    ranged = out.repartitionByRange("day", "cam_id", "timestamp").sortWithinPartitions("day", "cam_id", "timestamp")
    ranged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "cam_id").parquet(path)


def read_detections(spark: SparkSession, path: str, cam: int | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Detections of a camera from ``start`` to before ``end``: folders of other days and cameras are not read, nor files of other times."""
    rows = spark.read.parquet(path).withColumn("day", F.col("day").cast("string"))
    return in_range(rows, "timestamp", cam, start, end)
