"""Sharding (2): Karmarkar-Karp differencing over indivisible groups.

Rows with equal text are one group and stay in one shard. Groups (hash, bytes) are dealt to buckets by hash; every
bucket runs the differencing on its own groups: each group is a partial partition (its bytes in one of ``shards``
slots), and the two partial partitions of largest spread are combined, the fullest slots of one with the emptiest
of the other, until one is left. Buckets' partitions, ``shards`` sums each, are then combined in the same way,
``FAN`` in a task, level by level until one is left; nothing but a count reaches the driver.

Defined results: null text is a group with empty text and has 8 bytes; equal spreads go by order of the group's
hash; repeated rows are rows of one group; an empty table gives no rows; other columns are ignored. No group is
split, so one group of more than 1/24 of all bytes makes its shard the largest by that much.
"""

from __future__ import annotations

import heapq
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackledger.llm.common import cut, partitions, table

SHARDS = 24
BUCKET_GROUPS = 50_000
#: Partitions that one task combines.
FAN = 1_000


def difference(sums: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Combine partial partitions until one is left.

    ``sums``: (n, shards) bytes by slot. Returns the (n, shards) shard of each slot of each, and the shards' bytes.
    """
    n = len(sums)
    if not n:
        return np.zeros((0, shards), np.int64), np.zeros(shards, np.int64)
    nodes = [np.sort(s)[::-1] for s in sums]
    orders = [np.argsort(-s, kind="stable") for s in sums]  # slot at each rank
    heap = [(-int(s[0] - s[-1]), i) for i, s in enumerate(nodes)]
    heapq.heapify(heap)
    made: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = nodes[a] + nodes[b][::-1]
        order = np.argsort(-total, kind="stable")
        made.append((a, b, order))
        nodes.append(total[order])
        nodes[a] = nodes[b] = total[:0]
        heapq.heappush(heap, (-int(nodes[-1][0] - nodes[-1][-1]), len(nodes) - 1))
    # downwards: the shard of every rank of every node
    where: list[np.ndarray] = [np.zeros(0, np.int64)] * len(nodes)
    where[-1] = np.arange(shards)
    for k in range(len(made) - 1, -1, -1):
        a, b, order = made[k]
        up = np.empty(shards, np.int64)
        up[order] = where[n + k]  # by rank of a
        where[a], where[b] = up, up[::-1]
        where[n + k] = up[:0]
    out = np.empty((n, shards), np.int64)
    for i in range(n):
        out[i, orders[i]] = where[i] if made else orders[i]
    return out, nodes[-1] if made else sums[0]


def assign(groups: DataFrame, shards: int, n_buckets: int, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """``groups`` (g, bytes) -> (g, bucket, slot) and (bucket, slot, shard)."""

    def bucket(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("g")
        size = t.column("bytes").to_numpy().astype(np.int64)
        sums = np.zeros((len(size), shards), np.int64)
        sums[:, 0] = size
        slot, total = difference(sums, shards)
        return pa.table({
            "bucket": pa.array(np.full(len(size), key[0].as_py()), pa.int32()), "g": t.column("g"), "slot": pa.array(slot[:, 0], pa.int32()), "bytes": t.column("bytes"),
        })

    def combine(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("bucket", "ascending"), ("slot", "ascending")])
        name, at = np.unique(t.column("bucket").to_numpy(), return_inverse=True)
        slot = t.column("slot").to_numpy()
        sums = np.zeros((len(name), shards), np.int64)
        sums[at, slot] = t.column("bytes").to_numpy()
        shard, total = difference(sums, shards)
        node, size = key[0].as_py(), len(name) * shards
        return pa.table({
            "node": pa.array(np.full(size, node), pa.int32()), "bucket": pa.array(np.repeat(name, shards), pa.int32()), "slot": pa.array(np.tile(np.arange(shards), len(name)), pa.int32()),
            "up": pa.array(shard.ravel(), pa.int32()), "bytes": pa.array(total[shard.ravel()], pa.int64()),
        })

    placed = cut(groups.withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(n_buckets)).cast("int")).groupBy("bucket").applyInArrow(bucket, "bucket int, g string, slot int, bytes long"))
    sums = placed.groupBy("bucket", "slot").agg(F.sum("bytes").alias("bytes"))
    shard_of, n = placed.select("bucket", "slot").distinct().withColumns({"node": F.col("bucket"), "shard": F.col("slot")}), n_buckets
    while n > 1:
        # some partitions a task, until one is left; a slot of a partition becomes a slot of the combined one
        n = -(-n // fan)
        made = cut(sums.withColumn("node", F.floor(F.col("bucket") / fan).cast("int")).groupBy("node").applyInArrow(combine, "node int, bucket int, slot int, up int, bytes long"))
        step = made.select(F.col("bucket").alias("node"), F.col("slot").alias("shard"), F.col("node").alias("above"), "up")
        shard_of = cut(shard_of.join(step, ["node", "shard"]).select("bucket", "slot", F.col("above").alias("node"), F.col("up").alias("shard")))
        sums = made.select(F.col("node").alias("bucket"), F.col("up").alias("slot"), "bytes").distinct()
    return placed.select("g", "bucket", "slot"), shard_of.select("bucket", "slot", "shard")


def shard_documents(docs: DataFrame, shards: int = SHARDS, bucket_groups: int = BUCKET_GROUPS, fan: int = FAN) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): groups of equal texts in shards of nearly equal bytes, slots gapless from 0."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = cut(docs.select("doc_id", (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("g"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20)).cast("int").alias("part")))
    groups = cut(rows.groupBy("g").agg(F.sum("size").alias("bytes")))
    placed, shard_of = assign(groups, shards, max(1, -(-groups.count() // bucket_groups)), fan)
    n = partitions(rows)
    done = cut(rows.join(placed, "g").join(shard_of, ["bucket", "slot"]).select("doc_id", "size", "text_crc32", "shard", (F.col("part") % n).alias("part")))
    # slots: rows before a part of the shard, then the row's place in that part
    counts = done.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32")) - 1
    return done.withColumn("place", place).join(before, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("place")).alias("slot"))


def op2_kk_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = shard_documents(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


__all__ = ["assign", "difference", "op2_kk_sharding", "shard_documents"]
