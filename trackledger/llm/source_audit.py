"""Source divergence audit (11): how far sources of a language lie apart, and which terms make a source stand out.

Terms of a piece of texts are counted in tasks: words are cut as byte spans, coded by Arrow's dictionary, and leave the task as
(lang, source, term, occurrences, documents). Spark adds these up, keeps the terms that enough documents of the language hold, and
gives every kept term of a group its smoothed share p in exact decimals. From there two ways:

* *Terms* of a group are ranked by f(p, q), which rises with the group's count and falls with the language's. So a term can only
  be among the first k if fewer than k terms dominate it: at least its group count, at most its language count, earlier in UTF-8.
  Every partition retains this k-skyband of its terms; skybands are merged, ``FAN`` partitions a task, level by level, and only
  what is left is ranked exactly. Dominance is transitive, so the skyband of merged skybands is the skyband of all.
* *Pairs* of sources: blocks of a language's terms become matrices of shares (terms by sources, absent terms with the share of
  count 0), whose columns are held against each other; the blocks' sums are added. A language with S sources has S x (S - 1) rows of
  result, and blocks have the size that ``blocks_of`` gives.

Defined results: null text, lang and source are ''; a group without terms has all counts 0; a language without kept terms has
pairs of value 0 and no terms; repeated rows and null ids are documents like others; an empty table gives no rows; further
columns are ignored. Shares use decimals of 38 digits, and f fits 64 bits, as p is at most 1000000001.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackledger.llm.common import FOLD, cut, partitions, pieces, small_batches, table, words

#: Bytes of terms: ASCII letters and all bytes of other characters.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
SCALE = 1_000_000_000
#: Partitions whose skybands one task merges.
FAN = 64
#: Groups up to which their table is broadcast (some 100 bytes each); beyond that it is joined by shuffle.
MOST_BROADCAST = 50_000
COUNTED = "lang string, source string, term string, n long, docs long"
BAND = "lang string, source string, node int, term string, n long, total long"


# ---------------------------------------------------------------- counting
def piece_counts(data: np.ndarray, offs: np.ndarray, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of a piece, and rows (group, term's number, occurrences, documents); ``group`` numbers each document's group."""
    starts, ends, doc = words(data, offs, LETTERS)
    flat = FOLD[data[LETTERS[data]]]
    bounds = np.append(0, np.cumsum(ends - starts)).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(flat)]).dictionary_encode()
    size = max(1, len(coded.dictionary))
    pair, n = np.unique(doc * size + coded.indices.to_numpy(), return_counts=True)  # (document, term)
    key = group[pair // size] * size + pair % size
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))[: len(key)]
    if not len(key):
        return coded.dictionary, key, key, key, key
    return coded.dictionary, key[first] // size, key[first] % size, np.add.reduceat(n, first), np.diff(np.append(first, len(key)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, offs in pieces(batches, size=4 << 20):
        lang, source = (part.column(c).dictionary_encode() for c in ("lang", "source"))
        number = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
        terms, group, term, n, docs = piece_counts(data, offs, number)
        found = {"lang": lang.dictionary.take(pa.array(group // len(source.dictionary))), "source": source.dictionary.take(pa.array(group % len(source.dictionary)))}
        found["term"] = terms.take(pa.array(term)).cast(pa.string())
        yield pa.record_batch(found | {"n": pa.array(n, pa.int64()), "docs": pa.array(docs, pa.int64())})


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in a group, and the group's documents that hold it."""
    small_batches(docs.sparkSession)
    filled = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return filled.mapInArrow(_count, COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


# ---------------------------------------------------------------- skybands
def skyband(term: list[str], n: np.ndarray, total: np.ndarray, k: int, block: int = 512) -> np.ndarray:
    """Places of the terms that fewer than ``k`` others dominate: n at least as high, total at most as high, earlier in UTF-8."""
    order = np.array(sorted(range(len(term)), key=lambda i: term[i].encode()), np.int64)
    kept = np.zeros(0, np.int64)
    for at in range(0, len(order), block):
        new = order[at : at + block]
        # dominators beyond the skyband only add to what the skyband's own already tell, so those kept suffice
        over = np.zeros(len(new), np.int64)
        for k0 in range(0, len(kept), 8192):
            old = kept[k0 : k0 + 8192]
            over += ((n[old] >= n[new, None]) & (total[old] <= total[new, None])).sum(1)
        within = np.tril((n[new] >= n[new, None]) & (total[new] <= total[new, None]), -1)
        chosen = over < k
        # a term of the block counts as a dominator whether kept or not: one that isn't has k dominators that dominate further
        chosen &= over + within.sum(1) < k
        kept = np.concatenate([kept, new[chosen]])
    return kept


def _bands(rows: dict[tuple[str, str], tuple[list[str], list[int], list[int]]], node: int, k: int) -> Iterator[pa.RecordBatch]:
    for (lang, source), (term, n, total) in rows.items():
        at = skyband(term, np.array(n, np.int64), np.array(total, np.int64), k)
        same = {"lang": pa.array([lang] * len(at), pa.string()), "source": pa.array([source] * len(at), pa.string()), "node": pa.array([node] * len(at), pa.int32())}
        yield pa.record_batch(same | {"term": pa.array([term[i] for i in at], pa.string()), "n": pa.array(n, pa.int64()).take(pa.array(at)), "total": pa.array(total, pa.int64()).take(pa.array(at))})


def skybands(kept: DataFrame, k: int, fan: int = FAN) -> DataFrame:
    """(lang, source, term, n, total) that fewer than ``k`` terms of the group dominate; ``kept`` has these columns."""
    n = partitions(kept)

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition's skybands: rows are gathered and, at every doubling, reduced to what may still be retained."""
        held: dict[tuple[str, str], tuple[list[str], list[int], list[int]]] = {}
        node, size, bound = 0, 0, 50_000
        for batch in batches:
            if batch.num_rows:
                node = batch.column("node")[0].as_py()
            for lang, source, *row in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "term", "n", "total")), strict=True):
                for column, value in zip(held.setdefault((lang, source), ([], [], [])), row, strict=True):
                    column.append(value)
            size += batch.num_rows
            if size > bound:
                for group, (term, count, total) in held.items():
                    at = skyband(term, np.array(count, np.int64), np.array(total, np.int64), k)
                    held[group] = ([term[i] for i in at], [count[i] for i in at], [total[i] for i in at])
                size = sum(len(x[0]) for x in held.values())
                bound = max(50_000, 2 * size)
        yield from _bands(held, node, k)

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: tuple[list[str], list[int], list[int]] = ([], [], [])
        for batch in batches:
            for column, c in zip(rows, ("term", "n", "total"), strict=True):
                column += batch.column(c).to_pylist()
        lang, source, node = (x.as_py() for x in key)
        yield from _bands({(lang, source): rows}, node, k)

    dealt = kept.select("lang", "source", F.pmod(F.xxhash64("lang", "term"), F.lit(n)).cast("int").alias("node"), "term", "n", "total")
    bands = dealt.repartition(n, "node").sortWithinPartitions("node").mapInArrow(shrink, BAND)
    while n > 1:
        n = -(-n // fan)
        up = bands.withColumn("node", F.floor(F.col("node") / fan).cast("int"))
        bands = up.groupBy("lang", "source", "node").applyInArrow(merge, BAND)
    return bands.drop("node")


# ---------------------------------------------------------------- pairs
def blocks_of(v: Column, n_sources: Column) -> Column:
    """Blocks for a language's terms: of 65,536 cells (terms by sources) or, if that is more, as many as a block's result has, up to four million."""
    cells = F.least(F.greatest(F.lit(1 << 16), n_sources * n_sources), F.lit(1 << 22))
    return F.greatest(F.ceil(v * n_sources / cells), F.lit(1)).cast("long")


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def pair_sums(share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block (terms, sources): first and second source of every pair, and the sum of f over the terms."""
    s = share.shape[1]
    left, right = np.triu_indices(s, 1)
    value = [divergence(share[:, i + 1 :], share[:, i, None]).sum(0) for i in range(s - 1)]
    return left, right, np.concatenate(value) if value else np.zeros(0, np.int64)


PAIRS = "lang string, a string, b string, value long"


def _pairs(key: tuple, rows: pa.Table, groups: pa.Table) -> pa.Table:
    sources = groups.column("source").to_pylist()
    place = {s: i for i, s in enumerate(sources)}
    coded = rows.column("term").combine_chunks().dictionary_encode() if rows.num_rows else None
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    share = np.tile(groups.column("p0").to_numpy(), (len(coded.dictionary) if coded is not None else 0, 1))
    if coded is not None:
        share[coded.indices.to_numpy(), [place[s] for s in rows.column("source").to_pylist()]] = rows.column("p").to_numpy()
    left, right, value = pair_sums(share)
    name = pa.array(sources, pa.string())
    return pa.table({"lang": pa.array([key[0].as_py()] * len(left), pa.string()), "a": name.take(pa.array(left)), "b": name.take(pa.array(right)), "value": pa.array(value, pa.int64())})


# ---------------------------------------------------------------- audit
def share(count: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 v)), exactly; null where there are no kept terms."""
    wide = lambda c: c.cast("decimal(20,0)")
    above, below = F.lit(SCALE).cast("decimal(10,0)") * (wide(count) + F.lit(2)), wide(total) + wide(v) * F.lit(2)
    return F.when(v > 0, F.lit(1) + F.call_function("div", above, below).cast("long"))


def source_audit(docs: DataFrame, min_docs: int = 10, ranks: int = 10, fan: int = FAN) -> DataFrame:
    """(lang, source, part, item, value, rank): for every source of a language the others by divergence, and its ``ranks`` most telling terms."""
    spark = docs.sparkSession
    counted = cut(term_counts(docs))
    per_term = Window.partitionBy("lang", "term")
    kept = cut(counted.withColumns({"total": F.sum("n").over(per_term), "held": F.sum("docs").over(per_term)}).where(F.col("held") >= min_docs).drop("docs", "held"))
    filled = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")])
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("own_total"))
    # a kept term of the language counts once: in the first of its sources
    once = F.row_number().over(Window.partitionBy("lang", "term").orderBy("source")) == 1
    langs = kept.withColumn("once", once).where("once").groupBy("lang").agg(F.count(F.lit(1)).alias("n_kept"), F.sum("total").alias("lang_total"))
    groups = filled.distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["own_total", "n_kept", "lang_total"])
    groups = cut(groups.withColumns({"n_sources": F.count(F.lit(1)).over(Window.partitionBy("lang")), "p0": share(F.lit(0), F.col("own_total"), F.col("n_kept"))}))
    near = F.broadcast(groups) if groups.count() <= MOST_BROADCAST else groups  # beyond that a join by shuffle

    blocks = blocks_of(F.col("n_kept"), F.col("n_sources"))
    shares = kept.join(near, ["lang", "source"]).select("lang", "source", "term", share(F.col("n"), F.col("own_total"), F.col("n_kept")).alias("p"), blocks.alias("blocks"))
    rows = shares.select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "term", "source", "p")
    every = groups.select("lang", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))).alias("block"), "source", F.coalesce("p0", F.lit(0)).alias("p0"))
    half = rows.groupBy("lang", "block").cogroup(every.groupBy("lang", "block")).applyInArrow(_pairs, PAIRS).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    half = cut(half)
    both = half.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(half.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))

    band = skybands(kept, ranks, fan).join(near, ["lang", "source"])
    p, q = share(F.col("n"), F.col("own_total"), F.col("n_kept")), share(F.col("total"), F.col("lang_total"), F.col("n_kept"))
    told = band.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q").withColumn("value", F.expr("(p - q) * (p - q) div (p + q)"))

    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")
    out = ["lang", "source", "part", "item", "value", "rank"]
    pairs = both.withColumns({"part": F.lit("pair"), "rank": place}).select(*out)
    return pairs.unionByName(told.withColumns({"part": F.lit("term"), "rank": place}).where(F.col("rank") <= ranks).select(*out))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), o AS (
  SELECT rid, lang, source, unnest(list_transform(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS term FROM d
), c AS (
  SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM o GROUP BY ALL
), k AS (
  SELECT lang, term, CAST(count(*) AS HUGEINT) AS total FROM o GROUP BY ALL HAVING count(DISTINCT rid) >= 10
), ln AS (
  SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(total) AS nl FROM k GROUP BY lang
), kc AS (
  SELECT c.lang, c.source, c.term, c.n, k.total FROM c JOIN k ON c.lang = k.lang AND c.term = k.term
), gs AS (
  SELECT lang, source, sum(n) AS n FROM kc GROUP BY ALL
), g AS (
  SELECT x.lang, x.source, CAST(coalesce(gs.n, 0) AS HUGEINT) AS ng, CAST(coalesce(ln.v, 0) AS HUGEINT) AS v, CAST(coalesce(ln.nl, 0) AS HUGEINT) AS nl
  FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN gs ON gs.lang = x.lang AND gs.source = x.source LEFT JOIN ln ON ln.lang = x.lang
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(kc.n, 0) AS n, 1 + (1000000000 * (coalesce(kc.n, 0) + 2)) // (g.ng + 2 * g.v) AS p, 1 + (1000000000 * (k.total + 2)) // (g.nl + 2 * g.v) AS q
  FROM g JOIN k ON k.lang = g.lang LEFT JOIN kc ON kc.lang = g.lang AND kc.source = g.source AND kc.term = k.term
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
