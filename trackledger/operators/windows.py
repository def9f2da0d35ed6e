"""Days, day-anchored windows, and which recordings fall into which window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackledger.functions.names import day_of


def _positive(hours: int) -> int:
    if hours <= 0:
        raise ValueError("a window has a positive number of hours")
    return int(hours)


def filter_days(df: DataFrame, days: list[str] | None, column: str = "day") -> DataFrame:
    """Rows of the requested days (exact text); None keeps all. Repeated days count once."""
    return df if days is None else df.where(F.col(column).isin(list(dict.fromkeys(days))))


def select_days(days: DataFrame, since: str | None = None, until: str | None = None, last: int | None = None) -> DataFrame:
    """Days (text, column ``day``) within bounds, and of those the last ``last``."""
    out = days.select("day").where(F.col("day").isNotNull()).distinct()
    if since is not None:
        out = out.where(F.col("day") >= since)
    if until is not None:
        out = out.where(F.col("day") <= until)
    if last is None:
        return out
    return out.orderBy(F.desc("day")).limit(last)


def catalog_days(videos: DataFrame, sources: DataFrame) -> DataFrame:
    """Days of the video catalog; where it has none, those of the source catalog."""
    first = videos.select(day_of(F.col("starttime")).alias("day")).where("day is not null").distinct().withColumn("rank", F.lit(0))
    second = sources.select(day_of(F.col("starttime")).alias("day")).where("day is not null").distinct().withColumn("rank", F.lit(1))
    both = first.union(second)
    return both.join(F.broadcast(both.agg(F.min("rank").alias("rank"))), "rank").select("day")  # one row


def day_range(start: Column, end: Column) -> Column:
    """Array of days (text) from ``start`` to ``end``, both included; an error where the end comes first."""
    span = F.sequence(start.cast("date"), end.cast("date"))
    checked = F.when(end < start, F.raise_error(F.lit("the end is before the start"))).otherwise(span)
    return F.transform(checked, lambda d: F.date_format(d, "yyyyMMdd"))


def day_windows(days: DataFrame, hours: int = 1) -> DataFrame:
    """(day, from_dt, to_dt): windows of ``hours`` from every midnight, the last one cut at the next."""
    hours = _positive(hours)
    day = F.to_timestamp_ntz(F.col("day"), F.lit("yyyyMMdd"))
    w = days.select("day").distinct().select("day", day.alias("midnight"), F.explode(F.sequence(F.lit(0), F.lit(23), F.lit(hours))).alias("h"))
    start = F.col("midnight") + F.make_dt_interval(hours=F.col("h"))
    return w.select("day", start.alias("from_dt"), F.least(start + F.make_dt_interval(hours=F.lit(hours)), F.col("midnight") + F.make_dt_interval(days=F.lit(1))).alias("to_dt"))


def _windows_a_day(hours: int) -> int:
    return -(-24 // _positive(hours))


def window_span(start: Column, end: Column, hours: int = 1) -> Column:
    """Struct (lo, hi) of the numbers of the day-anchored windows that a recording overlaps (half open); null where it overlaps none.

    Windows are numbered through all days. A recording of no length lies in the window around it, and in none where it lies on an edge; one
    that ends before it starts, or without an end, is in none.
    """
    n = _windows_a_day(hours)
    micros = lambda t: F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), t)
    day, hour = F.lit(86_400_000_000), F.lit(hours * 3_600_000_000)
    of = lambda m: (F.floor(m / day) * n + F.floor((m - F.floor(m / day) * day) / hour)).cast("long")
    edge = (micros(start) - F.floor(micros(start) / day) * day) % hour == 0
    return F.when(end > start, F.struct(of(micros(start)).alias("lo"), of(micros(end) - 1).alias("hi"))).when((end == start) & ~edge, F.struct(of(micros(start)).alias("lo"), of(micros(start)).alias("hi")))


def window_times(number: Column, hours: int = 1) -> tuple[Column, Column]:
    """When the window of a number begins and ends; the last one of a day ends at midnight."""
    n = _windows_a_day(hours)
    midnight = F.timestamp_add("DAY", F.floor(number / n).cast("int"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    begin = F.timestamp_add("HOUR", (F.pmod(number, F.lit(n)) * hours).cast("int"), midnight)
    return begin, F.least(F.timestamp_add("HOUR", F.lit(hours), begin), F.timestamp_add("DAY", F.lit(1), midnight))


def covered_windows(df: DataFrame, hours: int = 1, start: str = "starttime", end: str = "endtime") -> DataFrame:
    """Each row once for every window that it overlaps, with from_dt and to_dt. The windows are generated from the row, so no join on times is needed."""
    spans = df.withColumn("_span", window_span(F.col(start), F.col(end), hours)).where("_span is not null")
    begin, stop = window_times(F.col("_k"), hours)
    return spans.withColumn("_k", F.explode(F.sequence("_span.lo", "_span.hi"))).withColumns({"from_dt": begin, "to_dt": stop}).drop("_span", "_k")


#: Levels of the binary tree over windows: 2 ** 40 windows.
LEVELS = 40
#: A node of more windows is taken apart in two steps.
WIDE = 12


def tree_nodes(lo: Column, hi: Column) -> Column:
    """Array of (level, node): the fewest nodes of the binary tree over whole numbers that make up ``lo`` to ``hi``, two of a level at most."""
    top = F.ceil(F.log2((hi - lo + 2).cast("double"))).cast("int")

    def of(level: Column) -> Column:
        left, right = -F.call_function("shiftright", -lo, level), F.call_function("shiftright", hi + 1, level)
        node = lambda fits, at: F.when((left < right) & fits, F.struct(level.alias("level"), at.alias("node")))
        return F.array(node(F.pmod(left, F.lit(2)) == 1, left), node(F.pmod(right, F.lit(2)) == 1, right - 1))

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.least(top, F.lit(LEVELS))), of)), lambda n: n.isNotNull())


def window_units(sources: DataFrame, hours: int = 1, days: DataFrame | None = None) -> DataFrame:
    """(cam_id, from_dt, to_dt, latest_src_mtime): windows (of ``days``, text, or all) in which a camera has a recording, and its newest change.

    Recordings are told to nodes of a binary tree over all windows, two for each level at most, and aggregated there; a recording of one
    window is one node, one with a wrong end in ten years some tens. Windows of given days meet them by node, in an equi-join on their
    own ancestors. Without days every node is taken apart into its windows, after aggregation: as many rows as results.
    """
    rows = sources.where(F.col("cam_id").isNotNull()).select("cam_id", window_span(F.col("starttime"), F.col("endtime"), hours).alias("s"), "modified_time").where("s is not null")
    nodes = rows.select("cam_id", "modified_time", F.inline(tree_nodes(F.col("s.lo"), F.col("s.hi")))).groupBy("cam_id", "level", "node").agg(F.max("modified_time").alias("_m"))
    if days is None:
        over = F.greatest(F.col("level") - WIDE, F.lit(0))
        below = lambda node, levels: F.explode(F.sequence(F.call_function("shiftleft", node, levels), F.call_function("shiftleft", node + 1, levels) - 1))
        some = nodes.select("cam_id", "_m", F.least("level", F.lit(WIDE)).alias("level"), below(F.col("node"), over).alias("node"))
        met = some.select("cam_id", "_m", below(F.col("node"), F.col("level")).alias("k"))
    else:
        n = _windows_a_day(hours)
        day = F.date_diff(F.to_date("day", "yyyyMMdd"), F.lit("1970-01-01").cast("date")).cast("long")
        asked = days.where("day is not null").select(day.alias("d")).distinct().where("d is not null").select(F.explode(F.sequence(F.col("d") * n, F.col("d") * n + n - 1)).alias("k"))
        above = asked.select("k", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level")).withColumn("node", F.expr("shiftright(k, level)"))
        met = above.join(nodes, ["level", "node"]).select("cam_id", "_m", "k")
    begin, end = window_times(F.col("k"), hours)
    return met.groupBy("cam_id", "k").agg(F.max("_m").alias("_m")).select("cam_id", begin.alias("from_dt"), end.alias("to_dt"), F.col("_m").alias("latest_src_mtime"))


def last_n(df: DataFrame, n: int, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """The last ``n`` rows by ``order``, of all or of each group."""
    if by is None:
        return df.orderBy(*[c.desc() for c in order]).limit(n)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*[c.desc() for c in order]))).where(F.col("_n") <= n).drop("_n")
