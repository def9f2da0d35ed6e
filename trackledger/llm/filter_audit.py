"""Filter interaction audit (13): a contingency tensor for each part of the corpus, contracted for every order of the filters.

Five filters say pass or fail about every document; a part (a source) is then described by 2x2x2x2x2 counts, three times: of all
its documents, of those labelled good, of those labelled toxic. Everything asked about an order of filters is a contraction of
these tensors: along each axis a step takes those that pass, those that fail, or all.

Four filters depend on the text alone, so equal texts share their outcome; whether a document repeats a smaller doc_id's text
depends on its place among them. Documents shrink to (doc_id, part, digest of the text, four outcomes) in one pass of built-in
functions. Rows of one text, part and labels are counted together before they are shuffled by text, so a text that a third of all
documents share travels as a few rows; the first doc_id of each text is the least of these rows' least.

Defined results: null text is empty text; null source is part ''; a document without doc_id has no labels and repeats no one, nor
do others repeat it; rows of one doc_id don't repeat each other; of several labels for a doc_id any 1 counts, null labels are 0; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackledger.llm.common import cut, table

FILTERS = "ABCDE"
SPACES = " \t\n\x0b\x0c\r"
STEP = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)


def text_failures(text: Column) -> list[Column]:
    """Whether a text fails A (few words), B (repeated words), C (many capitals), D (signs of markup)."""
    bare = F.btrim(text, F.lit(SPACES))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))  # each is one byte
    return [n < 200, distinct.cast("long") * 100 < n.cast("long") * 50, capitals.cast("long") * 100 > F.char_length(text).cast("long") * 2, text.rlike(r"[#$%&*|]")]


def contingency(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, cell, good, toxic, n): documents of each part by outcome (bit i of ``cell``: the i-th filter fails) and labels."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    outcome = sum(F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(text_failures(F.col("text"))))
    own = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    own = cut(own.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), outcome.cast("int").alias("cell")))
    any_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c)
    labelled = labels.where("doc_id is not null").groupBy("doc_id").agg(any_one("quality"), any_one("toxic"))
    marks = [F.coalesce("quality", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")]
    known = own.where("doc_id is not null").join(labelled, "doc_id", "left").select(*own.columns, *marks)
    nameless = own.where("doc_id is null").select(*own.columns, F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    # rows of one doc_id together, then the least doc_id of each kind of row, with how many rows have it
    kind = ["digest", "part", "cell", "good", "toxic"]
    by_id = known.groupBy("doc_id", *kind).agg(F.count(F.lit(1)).alias("n"))
    kinds = by_id.groupBy(*kind).agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("least"))
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    split = kinds.withColumn("new", F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0))
    both = F.array(F.struct(F.col("cell"), F.col("new").alias("n")), F.struct((F.col("cell") + 16).alias("cell"), (F.col("n") - F.col("new")).alias("n")))
    cells = split.select("part", "good", "toxic", F.inline(both)).where("n > 0")
    cells = cells.unionByName(nameless.groupBy("part", "good", "toxic", "cell").agg(F.count(F.lit(1)).alias("n")))
    return cells.groupBy("part", "cell", "good", "toxic").agg(F.sum("n").alias("n"))


def steps(counts: np.ndarray) -> dict[str, np.ndarray]:
    """All orders' steps of one part; ``counts`` is (3, 2, 2, 2, 2, 2): all, good and toxic documents, 1 where a filter fails."""
    orders = list(permutations(range(len(FILTERS))))
    at = [(order, k) for order in orders for k in range(len(order))]

    def contract(rule: list[list[tuple[int, int]]]) -> np.ndarray:
        return np.einsum("tabcde,sa,sb,sc,sd,se->ts", counts, *np.array(rule, np.int64).transpose(1, 0, 2), optimize=True)

    def along(order: tuple[int, ...], k: int, before: tuple[int, int], own: tuple[int, int]) -> list[tuple[int, int]]:
        out = [ALL] * len(order)
        for f in order[:k]:
            out[f] = before
        out[order[k]] = own
        return out

    kept = contract([along(o, k, PASS, PASS) for o, k in at])[0]
    removed = contract([along(o, k, PASS, FAIL) for o, k in at])
    failing = contract([along(o, k, ALL, FAIL) for o, k in at])[0]
    alone = contract([[FAIL if f == o[k] else PASS for f in range(len(o))] for o, k in at])[0]
    filters = np.array([o[k] for o, k in at])
    shapley = np.array([removed[0][filters == f].sum() for f in range(len(FILTERS))])
    return {
        "filter_order": np.array(["".join(FILTERS[f] for f in o) for o, _ in at]), "step": np.array([k + 1 for _, k in at], np.int32), "kept": kept, "removed": removed[0],
        "redundant": failing - removed[0], "unique_fails": alone, "good_lost": removed[1], "toxic_lost": removed[2], "shapley": shapley[filters],
    }


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step, zeros included; a part's task sees its 128 counts at most."""

    def part_steps(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((3, 32), np.int64)
        for batch in batches:
            cell, good, toxic, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "good", "toxic", "n"))
            for row, chosen in enumerate((np.ones(len(n), bool), good.astype(bool), toxic.astype(bool))):
                np.add.at(counts[row], cell[chosen], n[chosen])
        # bit i of a cell is filter i: the last filter is the first axis of the reshaped cells
        made = steps(counts.reshape(3, 2, 2, 2, 2, 2).transpose(0, 5, 4, 3, 2, 1))
        yield pa.record_batch({"part": pa.array([key[0].as_py()] * len(made["step"]), pa.string())} | {k: pa.array(v) for k, v in made.items()})

    return contingency(docs, labels).groupBy("part").applyInArrow(part_steps, STEP)


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS first_id FROM d
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT w.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b,
    100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d, coalesce(w.doc_id > first_id, false) AS e
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id
), cells AS (
  SELECT part, [a, b, c, d, e] AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL
), one AS (
  SELECT unnest([1, 2, 3, 4, 5]) AS i
), orders AS (
  SELECT [p.i, q.i, r.i, s.i, t.i] AS o FROM one p, one q, one r, one s, one t WHERE len(list_distinct([p.i, q.i, r.i, s.i, t.i])) = 5
), asked AS (
  SELECT o, array_to_string(list_transform(o, lambda i: substring('ABCDE', i, 1)), '') AS filter_order, k.i AS step, o[k.i] AS f FROM orders, one k
), seen AS (
  SELECT part, filter_order, step, f, n, good, toxic, fails[f] AS fails_it, len(list_filter(o[1:step - 1], lambda i: fails[i])) > 0 AS gone, len(list_filter(fails, lambda x: x)) AS n_fails FROM cells, asked
), counted AS (
  SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (WHERE NOT gone AND NOT fails_it), 0) AS kept, coalesce(sum(n) FILTER (WHERE NOT gone AND fails_it), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE gone AND fails_it), 0) AS redundant, coalesce(sum(n) FILTER (WHERE fails_it AND n_fails = 1), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE NOT gone AND fails_it), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE NOT gone AND fails_it), 0) AS toxic_lost
  FROM seen GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM counted
"""
