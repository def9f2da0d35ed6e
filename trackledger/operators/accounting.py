"""What jobs used, and what they should ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackledger.functions.numbers import format_duration, format_kib, format_percent, memory_text, round_memory, round_minutes
from trackledger.sources.shared import written

# States that end a task; columns of an accounting line.
TERMINAL = ("COMPLETED", "TIMEOUT", "FAILED", "OUT_OF_MEMORY", "NODE_FAIL", "CANCELLED")
FIELDS = 21
# End of fixed values.


def read_accounting(lines: DataFrame, columns: list[str], line: str = "value") -> DataFrame:
    """``|``-separated lines as text columns, with is_step; lines of another width and array masters (``[`` in the id) are dropped."""
    parts = lines.select(F.split(F.col(line), r"\|", -1).alias("p")).where(F.size("p") == len(columns))
    rows = parts.select(*[F.col("p")[i].alias(c) for i, c in enumerate(columns)])
    return rows.where(~F.col(columns[0]).contains("[")).withColumn("is_step", F.col(columns[0]).contains("."))


def state_word(state: Column) -> Column:
    """``CANCELLED by 42`` is CANCELLED."""
    return F.split(state, " ")[0]


def merge_steps(tasks: DataFrame, steps: DataFrame) -> DataFrame:
    """``tasks`` (jobid, own_rss, own_cpu) with maxrss_kib and totalcpu_s of their steps (jobid, step, maxrss_kib, totalcpu_s).

    RSS is the most of the steps other than extern; if none has it, of all steps and the task. CPU is the batch step's, else the task's.
    """
    merged = steps.groupBy("jobid").agg(
        F.max(F.when(F.col("step") != "extern", F.col("maxrss_kib"))).alias("rss"), F.max("maxrss_kib").alias("any_rss"), F.max(F.when(F.col("step") == "batch", F.col("totalcpu_s"))).alias("cpu")
    )
    return tasks.join(merged, "jobid", "left").withColumns({"maxrss_kib": F.coalesce("rss", F.greatest("any_rss", "own_rss")), "totalcpu_s": F.coalesce("cpu", "own_cpu")}).drop("rss", "any_rss", "cpu")


def nearest_rank(df: DataFrame, by: str, column: str, qs: dict[str, float]) -> DataFrame:
    """(by, one column for each q): nearest-rank percentiles without nulls; q of 0 or less is the least value."""
    found = _ranks(df, by, [column], qs)
    return found.select(by, *[F.col(f"{column}_{n}").alias(n) for n in qs])


def state_counts(tasks: DataFrame) -> DataFrame:
    """(name, state, n)."""
    return tasks.groupBy("name", state_word(F.col("state")).alias("state")).agg(F.count(F.lit(1)).alias("n"))


def _ranks(df: DataFrame, by: str, columns: list[str], qs: dict[str, float]) -> DataFrame:
    """(by, column_q, ...): nearest ranks of several columns per group, in one pass that ranks all their values.

    Equal values are counted first; the counts are range-partitioned by group, column and value, and each partition adds up its
    own, behind what the partitions before it hold of the same group and column. No task holds a group.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)])).alias("x")
    counts = df.select(F.col(by).alias("g"), pairs).select("g", "x.c", "x.v").where("v is not null").groupBy("g", "c", "v").agg(F.count(F.lit(1)).alias("n"))
    ranged = written(counts.repartitionByRange("g", "c", "v").withColumn("part", F.spark_partition_id()))
    within = ranged.withColumn("upto", F.sum("n").over(Window.partitionBy("part", "g", "c").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    parts = ranged.groupBy("g", "c", "part").agg(F.sum("n").alias("part_n"))
    w = Window.partitionBy("g", "c")
    parts = parts.select(F.col("g").alias("pg"), F.col("c").alias("pc"), F.col("part").alias("pp"), (F.sum("part_n").over(w.orderBy("part")) - F.col("part_n")).alias("before"), F.sum("part_n").over(w).alias("all"))
    ranked = within.join(parts, F.col("g").eqNullSafe(F.col("pg")) & (F.col("c") == F.col("pc")) & (F.col("part") == F.col("pp"))).withColumn("upto", F.col("upto") + F.col("before"))

    def at(i: int, q: float) -> Column:
        wanted = F.greatest(F.lit(1.0), F.lit(float(q)) * F.col("all"))
        return F.max(F.when((F.col("c") == i) & (F.col("upto") >= wanted) & (F.col("upto") - F.col("n") < wanted), F.col("v")))

    kinds = dict(df.dtypes)
    found = ranked.groupBy(F.col("g").alias("_group")).agg(*[at(i, q).cast(kinds[c]).alias(f"{c}_{n}") for i, c in enumerate(columns) for n, q in qs.items()])
    groups = df.select(by).distinct()
    return groups.join(found, F.col(by).eqNullSafe(F.col("_group")), "left").drop("_group")


def resource_summary(tasks: DataFrame, chunks: DataFrame | None = None, default_chunk: int = 32) -> DataFrame:
    """Per job name: tasks, states, percentiles of elapsed, RSS, efficiencies and time per item; ``chunks`` has name, chunk.

    ``tasks`` has name, state, elapsed_s, timelimit_s, ncpus, reqmem_kib, maxrss_kib, totalcpu_s, jobid.
    """
    t = tasks.withColumn("state", state_word(F.col("state")))
    t = (t.join(chunks, "name", "left") if chunks is not None else t.withColumn("chunk", F.lit(None).cast("int"))).withColumn("chunk", F.coalesce("chunk", F.lit(default_chunk)))
    terminal = F.col("state").isin(*TERMINAL) & (F.col("elapsed_s") > 0)
    ratio = lambda a, b: F.when((a != 0) & (b != 0), a / b)
    ended = t.where(terminal).withColumns({
        "mem_eff": ratio(F.col("maxrss_kib"), F.col("reqmem_kib")), "time_eff": ratio(F.col("elapsed_s"), F.col("timelimit_s")), "cpu_eff": ratio(F.col("totalcpu_s"), F.col("elapsed_s") * F.col("ncpus")),
        "done_item": F.when(F.col("state") == "COMPLETED", F.col("elapsed_s") / F.col("chunk")), "any_item": F.col("elapsed_s") / F.col("chunk"),
    })
    qs = {"p50": 0.5, "p95": 0.95, "max": 1.0}
    ranks = _ranks(ended, "name", ["elapsed_s", "maxrss_kib", "mem_eff", "time_eff", "cpu_eff", "done_item", "any_item"], qs)
    mins = ended.groupBy("name").agg(F.min("elapsed_s").alias("elapsed_s_min"), F.count(F.lit(1)).alias("terminal"), F.count_if(F.col("state") == "COMPLETED").alias("completed"), F.count_if((F.col("state") == "FAILED") & (F.col("elapsed_s") < 60)).alias("short_failures"))
    head = t.groupBy("name").agg(F.count(F.lit(1)).alias("tasks"), F.min_by("reqmem_kib", "jobid").alias("reqmem_kib"), F.first("chunk").alias("chunk"))
    out = head.join(mins, "name", "left").join(ranks, "name", "left")
    for n in qs:
        out = out.withColumn(f"per_item_{n}", F.coalesce(f"done_item_{n}", f"any_item_{n}")).drop(f"done_item_{n}", f"any_item_{n}")
    return out


def right_size(summary: DataFrame, target_minutes: int = 180, time_factor: float = 1.5, memory_factor: float = 1.3) -> DataFrame:
    """(name, mem_mib, minutes, chunk, chunk_minutes, low_evidence) from ``resource_summary``."""
    item = F.col("per_item_p95") * time_factor
    chunk = F.greatest(F.lit(1), F.floor(target_minutes * 60 / item)).cast("long")
    low = F.col("completed") < F.greatest(F.lit(3.0), 0.1 * F.col("terminal"))
    return summary.select("name", round_memory(F.col("maxrss_kib_p95") * memory_factor / 1024).alias("mem_mib"), round_minutes(F.col("elapsed_s_p95") * time_factor).alias("minutes"), chunk.alias("chunk"), round_minutes(chunk * item).alias("chunk_minutes"), low.alias("low_evidence"))


def resource_table(summary: DataFrame) -> DataFrame:
    """Per job name the figures as they are read: durations, memory, shares, and the recommended memory."""
    return summary.select(
        "name", "tasks", format_duration(F.col("elapsed_s_p50")).alias("elapsed_p50"), format_duration(F.col("elapsed_s_p95")).alias("elapsed_p95"), format_kib(F.col("maxrss_kib_p95")).alias("rss_p95"),
        format_percent(F.col("time_eff_p50")).alias("time_eff"), format_percent(F.col("mem_eff_p50")).alias("mem_eff"), memory_text(F.col("maxrss_kib_p95") * 1.3 / 1024).alias("memory"),
    )
