"""Greedy choices along a sorted group, in parallel: keep the first row, then always the next one that reaches what the kept row asks for.

Every row has a value and a threshold. After a kept row the next kept one is the first later row whose value is at least the kept row's
threshold (a null threshold: the next row). Each row's successor is thus known by itself, from a sorted search in the running
maximum of the values (kept rows are maxima of all before them, so for them the running maximum finds the right row). What the first
row reaches by successors is what a walk would keep; it is found by pointer doubling, all rows at once.

Groups up to ``slice_rows`` rows lie in one task each. A larger group is cut into ranges. A range turns the threshold that comes in into
the one that goes out; the thresholds that leave ranges are few, each is looked up in the range where it lands, and doubling over these
(range, threshold) pairs finds the ones that the first row reaches. Then every range marks its own rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackledger.sources.shared import written

SLICE_ROWS = 500_000
#: Less than any value: a threshold that every row reaches.
LEAST = -(2**63)


def successors(group: np.ndarray, value: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    """For rows sorted by group (numbers that rise): the place of each row's successor, or the number of rows where there is none."""
    n = len(value)
    if not n:
        return np.zeros(0, np.int64)
    size = 2 * n + 1
    rank = np.unique(np.concatenate([value, threshold]), return_inverse=True)[1]
    reach = np.maximum.accumulate(group * size + rank[:n])  # groups rise, so the maximum starts anew with each
    found = np.maximum(np.searchsorted(reach, group * size + rank[n:], "left"), np.arange(1, n + 1))
    ends = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, n)
    return np.where(found < ends[np.searchsorted(ends, np.arange(n), "right")], found, n)


def reached(successor: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which rows the ``first`` ones reach, themselves included."""
    n = len(successor)
    hit = np.zeros(n + 1, bool)
    hit[first] = True
    jump = np.append(successor, n)
    while (jump < n).any():
        hit[jump[hit]] = True
        jump = jump[jump]
    return hit[:n]


def lasts(successor: np.ndarray) -> np.ndarray:
    """The last row that each row reaches."""
    n = len(successor)
    at = np.where(successor < n, successor, np.arange(n))
    while (at[at] != at).any():
        at = at[at]
    return at


def _groups(batch: pa.Table, by: list[str]) -> np.ndarray:
    """Numbers of the groups of rows that are sorted by them."""
    new = np.zeros(batch.num_rows, bool)
    for c in by:
        code = batch.column(c).combine_chunks().dictionary_encode(null_encoding="encode")
        code = (code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code).indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.cumsum(new).astype(np.int64)


def _marked(rows: pa.Table, by: list[str]) -> pa.Table:
    group = _groups(rows, by)
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1])[: len(group)])
    hit = reached(successors(group, rows.column("_value").to_numpy(), rows.column("_threshold").to_numpy()), first)
    return rows.append_column("_kept", pa.array(hit))


def keep_greedily(df: DataFrame, by: list[str], order: list[str], value: Column, threshold: Column, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``df`` with _kept; ``value`` (not null) and ``threshold`` are whole numbers, rows of a group go in the order of ``order``."""
    rows = df.withColumns({"_value": value.cast("long"), "_threshold": F.coalesce(threshold.cast("long"), F.lit(LEAST))})
    large = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > slice_rows)
    any_large = not large.isEmpty()
    large = written(large) if any_large else large
    out = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", _kept boolean"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups come sorted; what may be the start of a group that goes on is held back."""
        held: list[pa.RecordBatch] = []
        size, enough = 0, 100_000
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < enough:
                continue
            table = pa.Table.from_batches(held)
            group = _groups(table, by)
            cut = int(np.searchsorted(group, group[-1], "left"))
            if cut:
                yield from _marked(table.slice(0, cut), by).combine_chunks().to_batches()
            rest = table.slice(cut)
            held, size = rest.to_batches(), rest.num_rows
            enough = 100_000 + 2 * size
        if size:
            yield from _marked(pa.Table.from_batches(held), by).combine_chunks().to_batches()

    small = rows.join(large, by, "left_anti") if any_large else rows
    done = small.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(whole, out)
    if any_large:
        done = done.unionByName(_in_ranges(rows.join(large.drop("_n"), by, "left_semi"), by, order, out, slice_rows))
    return done.drop("_value", "_threshold")


EDGE = "_slice int, _in long, _to int, _out long"


def _in_ranges(rows: DataFrame, by: list[str], order: list[str], out: str, slice_rows: int) -> DataFrame:
    """The same for groups of any size. (A group with a null key finds no match here and stays with the others, in one task.)"""
    columns = [*rows.columns, "_kept"]
    keys = [f"_k{i}" for i in range(len(by))]
    rows = rows.withColumns(dict(zip(keys, map(F.col, by), strict=True)))
    n = max(2, -(-rows.count() // slice_rows))
    placed = written(rows.repartitionByRange(n, *by, *order).withColumn("_part", F.spark_partition_id()))
    bounds = placed.groupBy(*keys, "_part").agg(F.max("_value").alias("_most"))
    w = Window.partitionBy(*keys).orderBy("_part")  # a row for each range
    bounds = written(bounds.withColumns({"_slice": (F.row_number().over(w) - 1).cast("int"), "_most": F.max("_most").over(w), "_before": F.coalesce(F.max("_most").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(LEAST))}))
    sliced = placed.join(bounds.drop("_most"), [*keys, "_part"]).drop("_part")
    key_types = ", ".join(f"`{k}` {dict(rows.dtypes)[k]}" for k in keys)

    def local(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        """Rows in order, their running maxima (with those of the ranges before) and thresholds."""
        table = table.sort_by([(c, "ascending") for c in order])
        before = table.column("_before")[0].as_py()
        return table, np.maximum(np.maximum.accumulate(table.column("_value").to_numpy()), before), table.column("_threshold").to_numpy()

    def named(key: tuple, n_rows: int) -> dict[str, pa.Array]:
        return {k: pa.array([v.as_py()] * n_rows, v.type) for k, v in zip(keys, key, strict=False)}

    def leaving(key: tuple, table: pa.Table) -> pa.Table:
        """All thresholds that may leave a range."""
        table, most, asked = local(table)
        left = np.unique(asked[lasts(successors(np.zeros(len(most), np.int64), most, asked))])
        return pa.table(named(key, len(left)) | {"_from": pa.array([key[-1].as_py()] * len(left), pa.int32()), "_in": pa.array(left)})

    def through(key: tuple, table: pa.Table, coming: pa.Table) -> pa.Table:
        """What becomes of each threshold that comes in."""
        came = np.unique(coming.column("_in").to_numpy())
        if not table.num_rows or not len(came):
            return pa.table(named(key, 0) | {"_slice": pa.array([], pa.int32()), "_in": pa.array([], pa.int64()), "_out": pa.array([], pa.int64())})
        _, most, asked = local(table)
        last = lasts(successors(np.zeros(len(most), np.int64), most, asked))
        left = asked[last[np.searchsorted(most, came, "left")]]
        return pa.table(named(key, len(came)) | {"_slice": pa.array([key[-1].as_py()] * len(came), pa.int32()), "_in": pa.array(came), "_out": pa.array(left)})

    def mark(key: tuple, table: pa.Table, coming: pa.Table) -> pa.Table:
        table, most, asked = local(table)
        first = np.searchsorted(most, coming.column("_in").to_numpy(), "left") if coming.num_rows else np.zeros(0, np.int64)
        hit = reached(successors(np.zeros(len(most), np.int64), most, asked), first[first < len(most)])
        return table.append_column("_kept", pa.array(hit)).select(columns)

    on = [*keys, "_slice"]
    # a threshold lands in the first range that reaches it, but always in a later one; beyond the last range it ends
    reach = bounds.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_slice", "_most"))).alias("_ranges"))
    lands = lambda frm, x: F.greatest(F.size(F.filter("_ranges", lambda r: r["_most"] < F.col(x))), F.col(frm) + 1).cast("int")

    left = sliced.groupBy(*on).applyInArrow(leaving, f"{key_types}, _from int, _in long").join(reach, keys)
    nodes = left.select(*keys, lands("_from", "_in").alias("_slice"), "_in", F.size("_ranges").alias("_n")).where("_slice < _n").drop("_n").distinct()
    starts = bounds.where("_slice = 0").select(*on, F.lit(LEAST).alias("_in"))
    nodes = written(nodes.unionByName(starts).distinct())
    passed = sliced.groupBy(*on).cogroup(nodes.groupBy(*on)).applyInArrow(through, f"{key_types}, _slice int, _in long, _out long").join(reach, keys)
    jump = written(passed.select(*on, "_in", lands("_slice", "_out").alias("_to"), "_out", F.size("_ranges").alias("_n")).where("_to < _n").drop("_n"))
    hit, steps = starts, bounds.agg(F.max("_slice")).first()[0] + 1  # one row
    while steps > 1:
        ahead = hit.join(jump, [*on, "_in"]).select(*keys, F.col("_to").alias("_slice"), F.col("_out").alias("_in"))
        hit = written(hit.unionByName(ahead).distinct())
        second = jump.select(*keys, F.col("_slice").alias("_to"), F.col("_in").alias("_out"), F.col("_to").alias("_to2"), F.col("_out").alias("_out2"))
        jump = written(jump.join(second, [*keys, "_to", "_out"]).select(*on, "_in", F.col("_to2").alias("_to"), F.col("_out2").alias("_out")))
        steps = -(-steps // 2)
    return sliced.groupBy(*on).cogroup(hit.groupBy(*on)).applyInArrow(mark, out)
