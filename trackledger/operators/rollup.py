"""Counts and shares per day and stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackledger.plans.status import PENDING, SKIPPED


def _counts() -> list[Column]:
    is_pending, is_skipped, is_done = F.col("status").isin(*PENDING), F.col("status").isin(*SKIPPED), F.col("status") == "done"
    return [F.count(F.lit(1)).alias("total"), F.count_if(is_done).alias("done"), F.count_if(is_pending).alias("pending"), F.count_if(is_skipped).alias("skipped")]


def _share() -> Column:
    of = F.col("done") + F.col("pending")
    return F.when(of > 0, 100.0 * F.col("done") / of).otherwise(100.0)


def by_day(units: DataFrame, *extra: str) -> DataFrame:
    """(day, total, done, pending, skipped, pct): skipped units are outside the share; a null day is a day of its own."""
    return units.groupBy(*extra, "day").agg(*_counts()).withColumn("pct", _share())


def stage_totals(units: DataFrame) -> DataFrame:
    """One row of totals; pct to two places, null without units."""
    return units.agg(*_counts()).withColumn("pct", F.when(F.col("total") > 0, F.round(_share(), 2)))


def status_counts(units: DataFrame) -> DataFrame:
    return units.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def pending_days(units: DataFrame) -> DataFrame:
    """One row: the days with pending units, in order."""
    return units.where(F.col("status").isin(*PENDING)).agg(F.array_sort(F.collect_set("day")).alias("days"))


def stage_summary(report: DataFrame) -> DataFrame:
    """(stage, totals, pct, first_day, last_day, any_pending) per stage, and a row for all stages (stage null)."""
    t = report.where("status <> 'unavailable'").rollup("stage").agg(*_counts(), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    return t.withColumns({"pct": F.when(F.col("total") > 0, F.round(_share(), 2)), "any_pending": F.col("pending") > 0})


def attention_days(units: DataFrame, most: int = 14) -> DataFrame:
    """The newest ``most`` days that have pending units, with how many more there are."""
    days = by_day(units).where("pending > 0")
    count = days.agg(F.count(F.lit(1)).alias("n_days"))
    return days.orderBy(F.desc("day")).limit(most).join(F.broadcast(count)).withColumn("more", F.greatest(F.col("n_days") - most, F.lit(0))).drop("n_days")  # one row


def overview(report: DataFrame) -> DataFrame:
    """(stage, line): each stage in one line."""
    s = stage_summary(report).where("stage is not null")
    return s.select("stage", F.concat("stage", F.lit(": "), F.col("done").cast("string"), F.lit("/"), (F.col("done") + F.col("pending")).cast("string"), F.lit(" done, "), F.col("skipped").cast("string"), F.lit(" skipped")).alias("line"))


def work_orders(report: DataFrame) -> DataFrame:
    """(stage, days, has_stubs, stub_days): what is left of each stage, for whoever starts the work."""
    p = report.where(F.col("status").isin(*PENDING))
    stub = F.col("status") == "zero_byte_stub"
    days = lambda c: F.array_join(F.array_sort(F.collect_set(c)), " ")
    return p.groupBy("stage").agg(days(F.col("day")).alias("days"), F.bool_or(stub).alias("has_stubs"), days(F.when(stub, F.col("day"))).alias("stub_days"))
