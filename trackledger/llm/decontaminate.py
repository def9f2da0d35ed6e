"""Benchmark decontamination (7): an FM-index per training shard, searched backwards for the benchmark's windows.

A window is ``window`` consecutive words of a benchmark item (all of a shorter item's). Words are numbered by the
benchmark's own vocabulary; any other document word is 0 and can't be in a window. A shard is about a megabyte of
documents (or one longer document): of it the runs of numbered words long enough for a window go into the index (suffix order by doubling,
Burrows-Wheeler transform in a wavelet tree with rank sums, every eighth suffix position kept). All windows are
searched backwards at once; ranges that stay open are located by walking to a kept position. Hit words are merged to
spans. Documents are never shuffled for a benchmark of one block; each block of a larger one is searched in a pass of its own.

Defined results: null or empty texts have no words; an item without words is never found; the words of an item without
item_id are hit, but it is not named or counted; repeated rows are separate documents, repeated items are found together;
an empty benchmark leaves all texts as they are. Columns named like a
result (n_words, n_hit, item_ids, spans) are replaced; other columns stay.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackledger.llm.common import ALNUM, cut, pieces, small_batches, span_hashes, table, text_buffer, with_row_id, words

SAMPLE = 8
ROW = "__row"
BLOCK_BYTES = 8 << 20


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Positions of ``s`` (ending in a smallest symbol) in suffix order, by prefix doubling."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    h = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - h] = rank[h:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.append(0, np.cumsum(sorted_key[1:] != sorted_key[:-1]))
        rank[order] = new
        if new[-1] == n - 1:
            return order
        h *= 2


class WaveletTree:
    """Rank and access over numbers below 2**bits: one level for each bit from the top, stably parted by it."""

    def __init__(self, s: np.ndarray, bits: int):
        self.bits, self.n = bits, len(s)
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(bits - 1, -1, -1):
            bit = (s >> level & 1).astype(bool)
            self.ones.append(np.append(0, np.cumsum(bit)).astype(np.int32))
            self.zeros.append(int((~bit).sum()))
            s = np.concatenate([s[~bit], s[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        start = np.zeros(len(at), np.int64)
        at = at.astype(np.int64)
        for ones, zeros, level in zip(self.ones, self.zeros, range(self.bits - 1, -1, -1), strict=True):
            bit = (symbol >> level & 1).astype(bool)
            a, b = ones[at], ones[start]
            at, start = np.where(bit, zeros + a, at - a), np.where(bit, zeros + b, start - b)
        return at - start

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols at positions, and how often each occurs before its position."""
        symbol = np.zeros(len(at), np.int64)
        start = np.zeros(len(at), np.int64)
        at = at.astype(np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            a, b = ones[at], ones[start]
            bit = ones[at + 1] > a
            symbol = symbol << 1 | bit
            at, start = np.where(bit, zeros + a, at - a), np.where(bit, zeros + b, start - b)
        return symbol, at - start


class FMIndex:
    """Words are numbers from 2; 1 parts the runs, and the only 0 ends the text."""

    def __init__(self, s: np.ndarray, top: int):
        order = suffix_order(s)
        bwt = s[order - 1]  # order - 1 is -1 for the first position: the last symbol
        self.tree = WaveletTree(bwt, max(1, int(top).bit_length()))
        self.less = np.append(0, np.cumsum(np.bincount(s, minlength=top + 1)))
        kept = order % SAMPLE == 0
        self.kept, self.position = kept, order[kept]
        self.before = np.append(0, np.cumsum(kept))
        self.n = len(s)

    def search(self, phrases: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of all phrases: rows of ``phrases`` are right-aligned."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        width = phrases.shape[1]
        for j in range(1, width + 1):
            step = live[length[live] >= j]
            if not len(step):
                break
            c = phrases[step, width - j]
            lo[step] = self.less[c] + self.tree.rank(c, lo[step])
            hi[step] = self.less[c] + self.tree.rank(c, hi[step])
            live = step[lo[step] < hi[step]]
        # ranges of phrases that died stay empty
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix ranks."""
        out, steps, at, todo = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64), rows.copy(), np.arange(len(rows))
        while len(todo):
            found = self.kept[at[todo]]
            done = todo[found]
            out[done] = self.position[self.before[at[done]]] + steps[done]
            todo = todo[~found]
            symbol, before = self.tree.access(at[todo])
            at[todo] = self.less[symbol] + before
            steps[todo] += 1
        return out % self.n


class Windows:
    """The distinct windows of a block of items, over the block's own vocabulary."""

    def __init__(self, ids: list[str | None], texts: pa.Array, window: int):
        data, offs = text_buffer(texts)
        start, end, item = words(data, offs, ALNUM)
        self.vocabulary, number = np.unique(span_hashes(data, start, end), return_inverse=True)
        size = np.bincount(item, minlength=len(ids))
        first = np.cumsum(size) - size
        # a window from every word that has enough words after it, and one from the first word of a shorter item
        left = np.repeat(first + size, size) - np.arange(len(item))
        at = np.flatnonzero((left >= window) | (np.arange(len(item)) == first[item]))
        length = np.minimum(left[at], window)
        phrases = np.zeros((len(at), window), np.int32)
        for j in range(window):  # right-aligned
            own = np.flatnonzero(length > j)
            phrases[own, window - 1 - j] = number[at[own] + length[own] - 1 - j] + 2
        self.phrases, which = np.unique(phrases, axis=0, return_inverse=True)
        self.length = (self.phrases > 0).sum(1)
        # the items of each window
        pair = np.unique(np.stack([which.ravel(), item[at]], 1), axis=0)
        self.owner, self.bounds = pair[:, 1], np.searchsorted(pair[:, 0], np.arange(len(self.phrases) + 1))
        self.ids = ids
        self.least = int(self.length.min()) if len(self.length) else 0

    def owners(self, which: int) -> list[str]:
        """Ids of the items that have a window; items without an id are not named."""
        return [self.ids[i] for i in self.owner[self.bounds[which] : self.bounds[which + 1]] if self.ids[i] is not None]

    def hits(self, number: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word and window of every occurrence among the words of a shard."""
        none = np.zeros(0, np.int64)
        if not len(self.length) or not len(number):
            return none, none
        known = number > 0
        edge = np.append(True, (known[1:] != known[:-1]) | (doc[1:] != doc[:-1]))
        first = np.flatnonzero(edge)
        size = np.diff(np.append(first, len(number)))
        use = known[first] & (size >= self.least)
        first, size = first[use], size[use]
        if not len(first):
            return none, none
        ends = np.cumsum(size + 1)  # each run and a 0 after it
        place = np.repeat(first - (ends - size - 1), size) + np.delete(np.arange(ends[-1]), ends - 1)
        text = np.ones(ends[-1] + 1, np.int64)
        text[-1] = 0
        origin = np.zeros(ends[-1] + 1, np.int64)
        inside = np.delete(np.arange(ends[-1]), ends - 1)
        text[inside], origin[inside] = number[place] + 1, place
        index = FMIndex(text, len(self.vocabulary) + 1)
        lo, hi = index.search(self.phrases, self.length)
        count = hi - lo
        which = np.repeat(np.arange(len(lo)), count)
        if not len(which):
            return none, none
        rank = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(len(which))
        return origin[index.locate(rank)], which


_held: dict[tuple[str, int], Windows] = {}


def _windows(block: Broadcast, window: int) -> Windows:
    """The windows of a broadcast block; a worker keeps those of one block for its next tasks."""
    name, ids, texts = block.value
    if (name, window) not in _held:
        _held.clear()
        _held[name, window] = Windows(ids, pa.array(texts, pa.string()), window)
    return _held[name, window]


def _occurrences(w: Windows, data: np.ndarray, offs: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
    """The words (start, end, document) of a piece, and first word and window of every occurrence in it."""
    found = words(data, offs, ALNUM)
    hashes = span_hashes(data, found[0], found[1])
    if not len(w.vocabulary) or not len(hashes):
        return found, np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(w.vocabulary, hashes), len(w.vocabulary) - 1)
    return found, *w.hits(np.where(w.vocabulary[at] == hashes, at + 1, 0), found[2])


def _covered(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in any run of words from ``first`` to before ``last``."""
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, first, 1)
    np.add.at(cover, last, -1)
    return np.cumsum(cover)[:-1] > 0


def _named(w: Windows, doc: np.ndarray, which: np.ndarray, n_docs: int) -> list[list[str]]:
    items: list[set[str]] = [set() for _ in range(n_docs)]
    for d, k in np.unique(np.stack([doc, which], 1), axis=0).tolist():
        items[d].update(w.owners(k))
    return [sorted(x) for x in items]


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES, remove: bool = False) -> DataFrame:
    """The columns of ``docs`` with n_words, n_hit, item_ids (array of strings, sorted) and spans (of bytes to remove, merged).

    ``benchmark`` has item_id and text. It is dealt to blocks of about ``block_bytes`` by a hash (at least one item each): a block at a
    time goes through the driver to the tasks. With one block the documents go through one pass; with more, each block's pass leaves a
    table of hits, and these are merged by document. With ``remove`` the spans are cut out of the texts.
    """
    spark = docs.sparkSession
    small_batches(spark)
    others = [c for c in docs.columns if c not in ("text", "n_words", "n_hit", "item_ids", "spans", ROW)]
    docs = docs.select(*others, F.col("text").cast("string").alias("text"))
    bench = benchmark.select(F.col("item_id").cast("string").alias("id"), F.col("text").cast("string").alias("text")).where("text is not null")
    blocks = max(1, -(-(bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))  # one row
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + ", n_words long, n_hit long, item_ids array<string>, spans array<struct<start:long,end:long>>"

    def block(b: int) -> Broadcast:
        rows = bench.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).collect()  # about block_bytes
        return spark.sparkContext.broadcast((uuid.uuid4().hex, [r["id"] for r in rows], [r["text"] for r in rows]))

    if blocks == 1:
        only = block(0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w = _windows(only, window)
            for part, data, offs in pieces(batches):
                (start, end, doc), first, which = _occurrences(w, data, offs)
                found = _found(part, start, end, doc, _covered(first, first + w.length[which], len(start)), _named(w, doc[first], which, part.num_rows), offs)
                yield _without_spans(found) if remove else found

        return docs.mapInArrow(run, schema)

    docs = with_row_id(docs, ROW)
    hits = []
    for b in range(blocks):
        one = block(b)

        def search(batches: Iterator[pa.RecordBatch], one: Broadcast = one) -> Iterator[pa.RecordBatch]:
            w = _windows(one, window)
            for part, data, offs in pieces(batches):
                (start, _, doc), first, which = _occurrences(w, data, offs)
                items = _named(w, doc[first], which, part.num_rows)
                hit = np.flatnonzero(_covered(first, first + w.length[which], len(start)))
                n = np.bincount(doc[hit], minlength=part.num_rows)
                some = np.flatnonzero(n)
                before = np.searchsorted(doc, np.arange(part.num_rows))
                at = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n[some])).astype(np.int32)), pa.array(hit - before[doc[hit]], pa.int64()))
                yield pa.record_batch({"__rid": part.column(ROW).take(pa.array(some)), "hit": at, "items": pa.array([items[i] for i in some.tolist()], pa.list_(pa.string()))})

        hits.append(cut(docs.select(ROW, "text").mapInArrow(search, "__rid long, hit array<long>, items array<string>")))
        one.destroy()
    merged = functools.reduce(DataFrame.union, hits).groupBy("__rid").agg(F.flatten(F.collect_list("hit")).alias("__hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("__items"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in pieces(batches):
            start, end, doc = words(data, offs, ALNUM)
            listed, hit = part.column("__hit"), np.zeros(len(start), bool)
            size = pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            hit[np.repeat(np.searchsorted(doc, np.arange(part.num_rows)), size) + listed.flatten().to_numpy(zero_copy_only=False).astype(np.int64)] = True
            found = _found(part.select([*others, "text"]), start, end, doc, hit, [x or [] for x in part.column("__items").to_pylist()], offs)
            yield _without_spans(found) if remove else found

    joined = docs.join(merged.hint("shuffle_hash"), F.col(ROW) == F.col("__rid"), "left").select(*others, "text", "__hit", "__items")
    return joined.mapInArrow(merge, schema)


def _found(part: pa.RecordBatch, start: np.ndarray, end: np.ndarray, doc: np.ndarray, hit: np.ndarray, items: list[list[str]], offs: np.ndarray) -> pa.RecordBatch:
    n = part.num_rows
    first = np.flatnonzero(hit & np.append(True, ~hit[:-1] | (doc[1:] != doc[:-1]))[: len(hit)])
    last = np.flatnonzero(hit & np.append(~hit[1:] | (doc[1:] != doc[:-1]), True)[: len(hit)])
    own = offs[doc[first]]
    bounds = np.append(0, np.cumsum(np.bincount(doc[first], minlength=n))).astype(np.int32)
    spans = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([pa.array(start[first] - own, pa.int64()), pa.array(end[last] - own, pa.int64())], ["start", "end"]))
    return pa.record_batch({name: part.column(name) for name in part.schema.names} | {
        "n_words": pa.array(np.bincount(doc, minlength=n), pa.int64()),
        "n_hit": pa.array(np.bincount(doc[hit], minlength=n), pa.int64()),
        "item_ids": pa.array(items, pa.list_(pa.string())),
        "spans": spans,
    })


def _without_spans(found: pa.RecordBatch) -> pa.RecordBatch:
    """The spans cut out of the texts; texts without spans stay as they are."""
    texts = found.column("text").to_pylist()
    for i, spans in enumerate(found.column("spans").to_pylist()):
        if spans:
            raw, out, at = texts[i].encode(), [], 0
            for s in spans:
                out.append(raw[at : s["start"]])
                at = s["end"]
            texts[i] = b"".join([*out, raw[at:]]).decode()
    return found.set_column(found.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))


def op7_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_benchmark(docs, table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bwin AS (
  SELECT DISTINCT item_id, len(x) AS n, array_to_string(x, ' ') AS g
  FROM (SELECT item_id, unnest(list_transform(range(greatest(1, len(w) - 9)), lambda i: w[i + 1 : i + 10])) AS x FROM bw WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT n FROM bwin
), dwin AS (
  SELECT rid, n, p, array_to_string(w[p + 1 : p + n], ' ') AS g
  FROM (SELECT rid, w, n, unnest(range(len(w) - n + 1)) AS p FROM dw, sizes WHERE len(w) >= n)
), hits AS (
  SELECT rid, item_id, p, n FROM dwin JOIN bwin USING (n, g)
), marked AS (
  SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM hits) GROUP BY rid
), named AS (
  SELECT rid, count(item_id) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN marked USING (rid) LEFT JOIN named USING (rid)
"""
