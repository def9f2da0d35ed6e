"""Line deduplication (3): two Bloom filters keep lines seen once off the shuffle.

Pass 1 fills, in every task, a filter of hashes seen and a filter of hashes seen again; the tasks' filters are cut into
slices and merged by slice (twice = either's twice, or both's once). Pass 2 looks every line up in the merged twice
filter: only suspected repeats, as (128-bit key, row), are shuffled, counted exactly and given a first occurrence.
Pass 3 brings each document the keys that it loses. The filters' size follows the bytes of text, up to 64 MB; beyond that
(some 4 GB of text) they fill up, and more lines count as suspects, up to all; the result stays the same.

A line's key is the line without white space (blank, tab to carriage return) at both ends, with A-Z in lower case.
Defined results: null or empty text is one empty line; empty keys are never dropped; repeated rows are separate
documents; an empty table gives no rows; of equal keys the first document in order of rows counts as first. Columns named like a result (n_lines, n_dropped) are replaced; others stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackledger.llm.common import NOT_SPACE, U64, bloom_has, cut, mix, pieces, small_batches, span_hashes, table, with_row_id
from trackledger.llm.twice import filter_size, twice_filter

SECOND = 1234567


def lines(data: np.ndarray, offs: np.ndarray, min_chars: int) -> dict[str, np.ndarray]:
    """All lines of all documents: start, end, document, and for keys long enough (``ok``) two 64-bit hashes."""
    breaks = np.flatnonzero(data == 10)
    # a document's own start comes before what its line breaks start; a break that ends the text starts an empty last line
    of_break = np.searchsorted(offs, breaks, "right") - 1
    order = np.lexsort((np.concatenate([offs[:-1], breaks + 1]), np.concatenate([np.arange(len(offs) - 1), of_break])))
    start = np.concatenate([offs[:-1], breaks + 1])[order]
    doc = np.concatenate([np.arange(len(offs) - 1), of_break])[order]
    end = np.append(start[1:] - 1, 0)
    last = np.append(doc[1:] != doc[:-1], True)
    end[last] = offs[doc[last] + 1]
    signs = np.flatnonzero(NOT_SPACE[data])
    if len(signs):
        lo = signs[np.minimum(np.searchsorted(signs, start), len(signs) - 1)]
        hi = signs[np.maximum(np.searchsorted(signs, end) - 1, 0)] + 1
        empty = (lo >= end) | (hi <= start)
        lo, hi = np.where(empty, start, lo), np.where(empty, start, hi)
    else:
        lo = hi = start
    chars = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    ok = (hi > lo) & (chars[hi] - chars[lo] >= min_chars)
    return {"start": start, "end": end, "doc": doc, "ok": ok, "h": span_hashes(data, lo, hi), "h2": span_hashes(data, lo, hi, seed=SECOND)}


def _distinct(found: dict[str, np.ndarray]) -> np.ndarray:
    """Places of the first line of every (document, key), among lines with a key."""
    at = np.flatnonzero(found["ok"])
    order = at[np.lexsort((at, found["h2"][at], found["h"][at], found["doc"][at]))]
    h, h2, d = (found[k][order] for k in ("h", "h2", "doc"))
    return order[np.append(True, (h[1:] != h[:-1]) | (h2[1:] != h2[:-1]) | (d[1:] != d[:-1]))[: len(order)]]


def drop_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none", filter_bits: int | None = None) -> DataFrame:
    """Drop lines whose key is in at least ``min_docs`` (2 or more) documents: all of them, or with ``keep="first"`` all but the first.

    Returns the columns of ``docs`` with the new text, and n_lines (before) and n_dropped.
    """
    if min_docs < 2 or keep not in ("none", "first") or (filter_bits is not None and (filter_bits & (filter_bits - 1) or filter_bits < 8)):
        raise ValueError("min_docs is 2 or more, keep is none or first, filter_bits a power of two")
    small_batches(docs.sparkSession)
    others = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped", "_rid", "_drop")]
    docs = with_row_id(docs.select(*others, F.col("text").cast("string").alias("text")))

    def keys(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        found = lines(data, offs, min_chars)
        return found["h"][_distinct(found)]

    shared = docs.sparkSession.sparkContext.broadcast(twice_filter(docs, keys, filter_bits or filter_size(docs, 0.125)))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in pieces(batches):
            found = lines(data, offs, min_chars)
            at = _distinct(found)
            at = at[bloom_has(shared.value, found["h"][at])]
            rid = part.column("_rid").to_numpy()
            yield pa.record_batch({"h": pa.array(found["h"][at].view(np.int64)), "h2": pa.array(found["h2"][at].view(np.int64)), "_rid": pa.array(rid[found["doc"][at]])})

    # two tables of their own: the join of suspects with common keys can then be split where one key has very many rows
    seen = cut(docs.select("_rid", "text").mapInArrow(suspects, "h long, h2 long, _rid long"))
    repeated = cut(seen.groupBy("h", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("_rid").alias("first")).where(F.col("n") >= min_docs).drop("n"))
    lost = seen.join(repeated, ["h", "h2"]).groupBy("_rid").agg(F.collect_list(F.struct("h", "h2", (F.col("first") == F.col("_rid")).alias("first"))).alias("_drop"))
    joined = docs.join(lost.hint("shuffle_hash"), "_rid", "left").select(*others, "text", F.col("_drop.h").alias("_h"), F.col("_drop.h2").alias("_h2"), F.col("_drop.first").alias("_first"))
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.select(*others).dtypes) + (", " if others else "") + "text string, n_lines long, n_dropped long"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in pieces(batches):
            yield _apply(part, data, offs, others, min_chars, keep == "first")

    return joined.mapInArrow(apply, schema)


def _key(h: np.ndarray, h2: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return mix(mix(h) + h2 * U64(0xD1342543DE82EF95) + doc.astype(U64) * U64(0xA0761D6478BD642F))


def _apply(part: pa.RecordBatch, data: np.ndarray, offs: np.ndarray, others: list[str], min_chars: int, keep_first: bool) -> pa.RecordBatch:
    found, n = lines(data, offs, min_chars), part.num_rows
    listed = part.column("_h")
    sizes = np.array([0 if x is None else len(x) for x in listed.to_pylist()], np.int64)
    h, h2, first = (np.asarray(part.column(c).flatten().to_numpy(zero_copy_only=False)) for c in ("_h", "_h2", "_first"))
    drop_key = _key(h.astype(np.int64).view(U64), h2.astype(np.int64).view(U64), np.repeat(np.arange(n), sizes))
    own = _key(found["h"], found["h2"], found["doc"])
    gone = found["ok"] & np.isin(own, drop_key)
    if keep_first and len(drop_key):
        here = gone & np.isin(own, drop_key[first.astype(bool)])
        at = np.flatnonzero(here)
        gone[at[np.unique(own[at], return_index=True)[1]]] = False
    n_lines, n_gone = np.bincount(found["doc"], minlength=n), np.bincount(found["doc"][gone], minlength=n)
    raw = data.tobytes()
    bounds = np.searchsorted(found["doc"], np.arange(n + 1))
    texts = []
    for i in range(n):
        if n_gone[i]:
            at = np.arange(bounds[i], bounds[i + 1])
            at = at[~gone[at]]
            texts.append(b"\n".join(raw[s:e] for s, e in zip(found["start"][at].tolist(), found["end"][at].tolist(), strict=True)))
        else:
            texts.append(raw[offs[i] : offs[i + 1]])
    columns = {c: part.column(c) for c in others}
    return pa.record_batch(columns | {"text": pa.array(texts, pa.binary()).cast(pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_gone, pa.int64())})


def op3_bloom_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_lines(docs, min_docs=10, min_chars=1).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


#: White space and upper case are spelled out: DuckDB's lower() and \s cover more characters.
ORACLE = r"""
WITH parts AS (
  SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT doc_id, rid, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM parts
), keyed AS (
  SELECT doc_id, rid, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), common AS (
  SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT rid) >= 10
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(common.k) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE common.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common ON keyed.k = common.k GROUP BY doc_id, rid
"""
