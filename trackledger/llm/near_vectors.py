"""Embedding near-dedup (8): spherical k-means cells, blocked cosine products within cells, one vector kept per group.

Equal vectors are one *point* with a multiplicity. Centroids are fitted on a bounded sample of points; every point
has a home cell (largest cosine). The way between two linked points in different cells crosses the border of these
cells, so one of the two lies within half the threshold's angle of it: a point visits each cell whose border with its
home is that near, and every link is found in the home cell of one of its ends, where the other lives or visits; recall
is 1 by construction. A point carries the list of its visits: a link found in both homes counts for the home's point in
each of them, one found in a single home counts for both ends there.
A cell is one task, to which each point travels once; only where it has more than ``HOME`` points at home or ``ALL`` in all is
it cut into blocks, and each pair of blocks is a task. Inside, products are taken ``STEP`` by ``STEP``. A task returns a link count
per point and a spanning forest of the links, never the links themselves. Points of every vector length with enough of them have
cells of their own, the others one cell for each length.

Defined results: a vector that is null, zero, or holds null or non-finite components links with nothing and is kept;
vectors of different length link never; repeated rows are linked copies; a null vec_id links with nothing; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackledger.llm.common import cut, table
from trackledger.llm.components import components, forest

SAMPLE_POINTS = 20_000
CELL_POINTS = 1_500
MOST_CELLS = 1_024
HOME, ALL, STEP = 8_192, 65_536, 1_024
#: Vector lengths that get centroids, the commonest first.
MOST_LENGTHS = 8


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """``k`` unit centroids of unit vectors; an empty cell takes the vector that fits its own cell worst."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        cos = x @ c.T
        own = cos.argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        worst = np.argsort(cos[np.arange(len(x)), own])
        for i, j in enumerate(np.flatnonzero(np.bincount(own, minlength=k) == 0)):
            sums[j] = x[worst[i]]
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), c)
    return c


def _unit(column: pa.Array) -> np.ndarray:
    """Unit rows of a list column whose lists are of one length."""
    return _unit_rows(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1))


def _unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps squares within range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_vectors(vectors: DataFrame, cosine: float = 0.95, sample_points: int = SAMPLE_POINTS, cell_points: int = CELL_POINTS, home: int = HOME, all_points: int = ALL, step: int = STEP) -> DataFrame:
    """``vectors`` (vec_id, embedding) -> (vec_id, n_links, component_id, kept), cosines in double precision."""
    spark = vectors.sparkSession
    good = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).withColumn("good", F.coalesce(good, F.lit(False)))
    # 128 bits name a vector from here on
    rows = rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), F.reverse("v"))})
    points = cut(rows.where("good").groupBy("h1", "h2").agg(F.first("v").alias("v"), F.min("vec_id").alias("p"), F.count(F.lit(1)).alias("copies")))
    lengths = points.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(MOST_LENGTHS).collect()
    if not lengths:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    centroids: dict[int, np.ndarray] = {}
    for r in lengths:
        if not centroids or r["count"] > cell_points:
            x = _unit(points.where(F.size("v") == r["dim"]).orderBy(F.xxhash64("p")).limit(sample_points).select("v").toArrow().column(0).combine_chunks())
            centroids[r["dim"]] = spherical_kmeans(x, max(1, min(MOST_CELLS, r["count"] // cell_points, len(x))))
    shared = spark.sparkContext.broadcast(centroids)
    reach = np.sqrt(max(0.0, (1 - cosine) / 2)) + 1e-9  # sine of half the angle
    kind = "<f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"  # as exact as they came

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.list_value_length(batch.column("v"))
            for dim in pc.unique(size).to_pylist():
                some = batch.filter(pc.equal(size, dim))
                sub = _unit(some.column("v"))
                c = shared.value.get(dim, np.zeros((1, dim)))
                d = sub @ c.T
                own = d.argmax(1)
                gap = d[np.arange(len(d)), own][:, None] - d
                apart = np.sqrt(np.maximum(2 - 2 * c @ c.T, 0))[own]
                visit = gap <= reach * apart + 1e-9
                visit[np.arange(len(d)), own] = True
                i, cell = np.nonzero(visit)
                lists = [x.astype("<i2").tobytes() for x in np.split(cell, np.cumsum(visit.sum(1))[:-1])]
                values = some.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(sub), -1).astype(kind)
                yield pa.record_batch({
                    "dim": pa.array(np.full(len(i), dim), pa.int32()), "cell": pa.array(cell, pa.int32()), "lives": pa.array(own[i], pa.int32()),
                    "visits": pa.array([lists[k] if lived else None for k, lived in zip(i.tolist(), (cell == own[i]).tolist(), strict=True)], pa.binary()),
                    "p": some.column("p").take(pa.array(i)), "copies": some.column("copies").take(pa.array(i)), "u": pa.array([values[k].tobytes() for k in i.tolist()], pa.binary()),
                })

    placed = cut(points.select("v", "p", "copies").mapInArrow(place, "dim int, cell int, lives int, visits binary, p long, copies long, u binary"))
    counts = placed.groupBy("dim", "cell").agg(F.count_if(F.col("cell") == F.col("lives")).alias("n_home"), F.count(F.lit(1)).alias("n_all"))
    counts = counts.select("dim", "cell", F.greatest(F.ceil(F.col("n_home") / home), F.lit(1)).cast("int").alias("bh"), F.ceil(F.col("n_all") / all_points).cast("int").alias("ba"))
    blocked = placed.join(counts, ["dim", "cell"]).withColumn("part", F.xxhash64("p"))
    inside = ["dim", "cell", "lives", "visits", "p", "copies", "u"]
    lives = F.col("cell") == F.col("lives")
    # a cell of one block has each point once, as both sides of its products
    whole = blocked.where("bh = 1 and ba = 1").select(*inside, F.lit(0).alias("i"), F.lit(0).alias("j"), lives.alias("home"), F.lit(True).alias("other"))
    large = blocked.where("bh > 1 or ba > 1")
    own = large.where(lives).select(*inside, F.pmod("part", "bh").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("ba") - 1)).alias("j"), F.lit(True).alias("home"), F.lit(False).alias("other"))
    other = large.select(*inside, F.explode(F.sequence(F.lit(0), F.col("bh") - 1)).alias("i"), F.pmod("part", "ba").cast("int").alias("j"), F.lit(False).alias("home"), F.lit(True).alias("other"))

    def compare(key: tuple, t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        p, copies, lives, is_home, is_other = (t.column(c).to_numpy() for c in ("p", "copies", "lives", "home", "other"))
        u = _unit_rows(np.frombuffer(b"".join(t.column("u").to_pylist()), kind).reshape(len(p), -1).astype(np.float64))
        h, o, cell = np.flatnonzero(is_home), np.flatnonzero(is_other), key[1].as_py()
        # the other cells that points at home visit
        seen = [np.frombuffer(x, "<i2") for x in t.column("visits").take(pa.array(h)).to_pylist()]
        met = np.zeros((len(h), MOST_CELLS), bool)
        met[np.repeat(np.arange(len(h)), [len(x) for x in seen]), np.concatenate([*seen, np.zeros(0, "<i2")])] = True
        links, edges = np.zeros(len(p), np.int64), []
        for x in (slice(s, s + step) for s in range(0, len(h), step)):
            for y in (o[s : s + step] for s in range(0, len(o), step)):
                i, j = np.nonzero(u[h[x]] @ u[y].T >= cosine)
                keep = p[h[x][i]] != p[y[j]]
                i, j = i[keep], j[keep]
                a, b = h[x][i], y[j]
                np.add.at(links, a, copies[b])
                # a guest whose home the other end does not visit meets it only here
                only = (lives[b] != cell) & ~met[x][i, lives[b]]
                np.add.at(links, b[only], copies[a[only]])
                if len(a):
                    nodes, at = np.unique(np.concatenate([p[a], p[b]]), return_inverse=True)
                    low = nodes[forest(at[: len(a)], at[len(a) :])]
                    edges.append(np.stack([nodes, low], 1)[low != nodes])
        e = np.concatenate([np.zeros((0, 2), np.int64), *edges])
        if len(e):
            nodes, at = np.unique(e, return_inverse=True)
            at = at.reshape(e.shape)
            low = nodes[forest(at[:, 0], at[:, 1])]
            e = np.stack([nodes, low], 1)[low != nodes]
        some = np.flatnonzero(links)
        return pa.table({
            "a": pa.array(np.concatenate([p[some], e[:, 0]]), pa.int64()), "b": pa.array(np.concatenate([p[some], e[:, 1]]), pa.int64()),
            "n": pa.array(np.concatenate([links[some], np.zeros(len(e), np.int64)]), pa.int64()),
        })

    found = cut(whole.union(own).union(other).groupBy("dim", "cell", "i", "j").applyInArrow(compare, "a long, b long, n long"))
    links = found.where("a = b").groupBy(F.col("a").alias("p")).agg(F.sum("n").alias("n"))
    roots = components(found.where("a <> b").select("a", "b")).select(F.col("node").alias("p"), "root")
    named = points.join(links, "p", "left").join(roots, "p", "left").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "p").alias("component_id"), F.lit(True).alias("good"))
    return rows.drop("v").join(named, ["h1", "h2", "good"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept")
    )


def op8_spherical_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), cosine=0.95)


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), good AS (
  SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS norm FROM v
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(e, e) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.95
), reach AS (
  SELECT a AS node, a AS other FROM links UNION SELECT reach.node, links.b FROM reach JOIN links ON reach.other = links.a
), roots AS (
  SELECT node, min(other) AS root FROM reach GROUP BY node
), counts AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(root, vec_id) AS component_id, vec_id = coalesce(root, vec_id) AS kept
FROM v LEFT JOIN counts ON vec_id = counts.a LEFT JOIN roots ON vec_id = node
"""
