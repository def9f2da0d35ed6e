"""Connected components of an edge table, by local forests and then alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackledger.llm.common import cut


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For numbered nodes 0.. the smallest node of each one's component, by minima over edges and pointer jumps."""
    n = int(max(a.max(), b.max())) + 1 if len(a) else 0
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        while not np.array_equal(up := label[label], label):
            label = up
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    return label


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch of edges becomes the stars of its components: as many edges as nodes at most."""
    for batch in batches:
        a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        if len(nodes):
            root = forest(at[: len(a)], at[len(a) :])
            low = nodes[root]
            keep = low != nodes
            yield pa.record_batch({"a": pa.array(nodes[keep], pa.int64()), "b": pa.array(low[keep], pa.int64())})


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``edges`` (a long, b long) -> (node, root): the smallest node reachable from every node that has an edge.

    Nothing but a count reaches the driver; each round ends in a written table. Nodes of one component are
    never gathered: a round moves (node, smaller node) pairs, joined by key, where large stars are split by AQE.
    """
    e = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b")
    e = cut(e.mapInArrow(_local, "a long, b long").distinct())
    for _ in range(most_rounds):
        # every node to the smallest of its neighbours and itself; larger neighbours are handed to that smallest node
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low2 = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low2, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low2.select("a", F.col("m").alias("b")))
        nxt = cut(small.where("a <> b").distinct())
        # done when each left node has one edge and no root is itself a left node
        left = nxt.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        more = left.where("n > 1").limit(1).count() or nxt.join(left.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()
        e = nxt
        if not more:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return cut(e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots))
