"""Packing (1): lexical retrieval packing with a sharded BM25 index.

Documents become id arrays (a written table); document frequencies of all ids are counted over the whole corpus (as
many rows as the vocabulary, so they can be broadcast). A document's *signature* is the ranks of its ``SIGNATURE``
rarest ids that another document has too. Signatures are cut into ranges of about ``shard_tokens`` ids, ``MOST_RANGES``
at most (bounds from a sample, equal signatures salted): id arrays are shuffled and sorted, so documents with the same
rarest ids meet wherever they lay, at any size. A range is one shard; one that holds more than two shards' ids is read
shard by shard, so a task holds no more than that. A shard is indexed (postings by id, BM25 weights with the corpus-wide
statistics) and fills windows: a seed document, then its best unused neighbours, the last one cut where the window
ends; what is left of it is the next seed.

What still cannot meet: a document lies in one shard only, so two related documents whose rarest shared ids differ
(or whose signature is so common that it spans shards) may lie in two.

Defined results: null or empty text is the end id alone; equal scores go by signature, then salt; repeated rows and
null ids are packed as they are; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackledger.llm.bpe import Bpe
from trackledger.llm.common import cut, mix, partitions, pieces, release, small_batches, table

WINDOW = 2048
K1, B = 1.2, 0.75
SIGNATURE = 4
#: Documents from which the bounds of ranges are taken: so many for each range, and so many at least.
RANGE_SAMPLE, LEAST_SAMPLE = 64, 20_000
#: Ranges, at most: their sample and bounds pass through the driver. Larger ranges hold several shards, read one after the other.
MOST_RANGES = 32_768
RANGES_A_TASK = 16
#: The public tokenizer's added token.
SPECIAL = {"<|endoftext|>": 50256}
SIGN = np.uint64(1 << 63)
KEY = np.dtype([("sig", np.uint64), ("salt", np.uint64)])
#: Columns of pieces after doc_id, which keeps its own type.
OUT = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


@lru_cache(2)
def _bpe(path: str, special: tuple[tuple[str, int], ...]) -> Bpe:
    return Bpe(path, dict(special))


def tokenize(docs: DataFrame, ranks: str, end_id: int = 1, special: dict[str, int] | None = SPECIAL) -> DataFrame:
    """(doc_id, ids): little-endian unsigned 16-bit ids of every whole text, closed by ``end_id``.

    ``ranks`` is the path of a ``.tiktoken`` file with fewer than 65,536 ids, present on every node. The strings of ``special`` inside a text
    are their one id, as tokenizer libraries take them by default; with None they are ordinary text.
    """
    added = tuple(sorted((special or {}).items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(ranks, added)
        try:
            for part, data, offs in pieces(batches, size=8 << 20):  # fewer distinct words a byte
                ids, ends = bpe.encode(data, offs)
                ids = np.insert(ids, ends[1:], end_id).astype("<u2")
                ends = (ends + np.arange(len(ends))) * 2
                column = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])
                yield pa.record_batch({"doc_id": part.column("doc_id"), "ids": column})
        finally:
            bpe.known.clear()  # the worker lives on
            release()

    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, f"doc_id {docs.dtypes[0][1]}, ids binary")


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each id, in this partition; id -1 counts documents and -2 ids."""
    seen, place, last = np.zeros(1 << 16, np.int64), np.arange(1 << 12), np.zeros(1 << 16, np.int64)
    n_docs = n_ids = 0
    for batch in batches:
        for raw in batch.column("ids"):
            ids = np.frombuffer(raw.as_buffer(), "<u2")
            if len(ids) > len(place):
                place = np.arange(2 * len(ids))
            at = place[: len(ids)]
            last[ids] = at  # the last place of an id stands for it
            seen[ids[last[ids] == at]] += 1
            n_docs, n_ids = n_docs + 1, n_ids + len(ids)
    at = np.flatnonzero(seen)
    yield pa.record_batch({"id": pa.array(np.append(at, [-1, -2]), pa.int64()), "n": pa.array(np.append(seen[at], [n_docs, n_ids]), pa.int64())})


def ranks_of(df: np.ndarray) -> np.ndarray:
    """For every id its place among ids that two documents or more have, the rarest last; 0 for others."""
    shared = np.flatnonzero(df >= 2)
    rank = np.zeros(len(df), np.uint16)
    rank[shared[np.lexsort((shared, -df[shared]))]] = np.minimum(np.arange(1, len(shared) + 1), 65_535)
    return rank


def signatures(flat: np.ndarray, ends: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The ranks of each document's rarest shared ids, rarest first; no document is empty."""
    r = rank[flat]
    sizes = np.diff(ends, prepend=0)
    starts = ends - sizes
    sig = np.zeros(len(ends), np.uint64)
    for _ in range(SIGNATURE):
        top = np.maximum.reduceat(r, starts) if len(starts) else r[:0]
        sig = (sig << np.uint64(16)) | top.astype(np.uint64)
        r[r == np.repeat(top, sizes)] = 0
    return sig


def _keyed(batches: Iterator[pa.RecordBatch], rank: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches with their documents' keys and numbers of ids."""
    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        if not batch.num_rows:
            continue
        raw = [x.as_buffer() for x in batch.column("ids")]
        size = np.fromiter((x.size // 2 for x in raw), np.int64, len(raw))
        key = np.empty(len(raw), KEY)
        key["sig"] = signatures(np.frombuffer(b"".join(raw), "<u2"), np.cumsum(size), rank)
        key["salt"] = mix(np.arange(row, row + len(raw), dtype=np.uint64))
        row += len(raw)
        yield batch, key, size


def range_bounds(key: np.ndarray, size: np.ndarray, ranges: int) -> np.ndarray:
    """The first keys of all ranges but the first, which have about equally many ids in this sample."""
    order = np.argsort(key, order=("sig", "salt"))
    full = np.cumsum(size[order])
    at = np.searchsorted(full, full[-1] / ranges * np.arange(1, ranges)) if len(full) else []
    return np.unique(key[order][at]) if len(at) else key[:0]


class Shard:
    """A BM25 index over some documents' ids, and the windows filled from it."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float, query_terms: int | None = None):
        self.docs, self.query_terms = docs, query_terms
        terms, counts = zip(*(np.unique(d, return_counts=True) for d in docs), strict=True)
        size = np.fromiter(map(len, terms), np.int64, len(docs))
        self.ends = np.cumsum(size)
        self.term, tf = np.concatenate(terms), np.concatenate(counts).astype(np.float64)
        owner = np.repeat(np.arange(len(docs)), size)
        length = np.fromiter(map(len, docs), np.float64, len(docs))
        self.weight = idf[self.term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[owner] / mean))
        order = np.argsort(self.term, kind="stable")
        self.post_doc, self.post_weight = owner[order], self.weight[order]
        self.ptr = np.searchsorted(self.term[order], np.arange((1 << 16) + 1))
        # postings of ids that many documents have are kept as full rows, which add up faster
        common = np.flatnonzero(np.diff(self.ptr) > len(docs) // 16)
        self.row = np.full(1 << 16, -1)
        self.row[common] = np.arange(len(common))
        self.full = np.zeros((len(common), len(docs)), np.float32)
        dense = np.flatnonzero(self.row[self.term] >= 0)
        self.full[self.row[self.term[dense]], owner[dense]] = self.weight[dense]
        self.unused = np.ones(len(docs), bool)

    def neighbours(self, doc: int, most: int) -> Iterator[int]:
        """Unused documents, best first, ``most`` of them; those that share none of the query's ids come last, in order."""
        a, b = self.ends[doc - 1] if doc else 0, self.ends[doc]
        weight, term = self.weight[a:b], self.term[a:b]
        if self.query_terms and len(term) > self.query_terms:
            term = term[np.argsort(-weight, kind="stable")[: self.query_terms]]
        row = self.row[term]
        common = np.zeros(len(self.docs), np.float32)
        for r in row[row >= 0].tolist():  # row by row, so that equal documents get equal sums
            np.add(common, self.full[r], out=common)
        rare = term[row < 0]
        size = self.ptr[rare + 1] - self.ptr[rare]
        at = np.repeat(self.ptr[rare] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        score = np.bincount(self.post_doc[at], self.post_weight[at], len(self.docs)) + common
        score[~self.unused] = -1
        some = 16
        for take in (some, most) if most > some else (most,):  # a window is often full after a few
            at = np.flatnonzero(score >= 0)
            if len(at) > take:
                least = np.partition(score, -take)[-take]
                above = np.flatnonzero(score > least)
                # ties at the end go by place, so that many equal documents need no sorting
                at = np.concatenate([above, np.flatnonzero(score == least)[: take - len(above)]])
            at = at[np.lexsort((at, -score[at]))]
            yield from at.tolist()
            score[at] = -1

    def windows(self, size: int) -> Iterator[list[tuple[int, int, int]]]:
        """Lists of (document, first id, ids); all but the last are full."""
        seed, at, first = -1, 0, 0
        while True:
            if seed < 0:
                while first < len(self.docs) and not self.unused[first]:
                    first += 1
                if first == len(self.docs):
                    return
                seed, at = first, 0
                self.unused[seed] = False
            n = len(self.docs[seed])
            if n - at >= size:
                yield [(seed, at, size)]
                at += size
                seed = seed if at < n else -1
                continue
            window, room, more = [(seed, at, n - at)], size - n + at, -1
            for d in self.neighbours(seed, room):  # no document is without ids
                if not room:
                    break
                self.unused[d] = False
                put = min(room, len(self.docs[d]))
                window.append((d, 0, put))
                room -= put
                if put < len(self.docs[d]):
                    more, at = d, put
            yield window
            seed = more


def _powers_of_two(window: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """A short window as windows whose lengths are powers of two: these need no padding."""
    left = sum(w[2] for w in window)
    out: list[tuple[int, int, int]] = []
    room = 1 << left.bit_length() - 1
    for d, at, n in window:
        while n:
            put = min(room, n)
            out.append((d, at, put))
            at, n, room, left = at + put, n - put, room - put, left - put
            if not room:
                yield out
                out, room = [], 1 << left.bit_length() - 1 if left else 0


def pack(docs: DataFrame, ranks: str, window: int = WINDOW, end_id: int = 1, shard_tokens: int = 2_000_000, split_tail: bool = True, query_terms: int | None = None, special: dict[str, int] | None = SPECIAL) -> DataFrame:
    """Pack whole documents into sequences of at most ``window`` ids; one row for each piece of a document.

    Columns: doc_id, start (ids of its document before the piece), length, ids (little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset (in the sequence). Each id lies in exactly one piece. Each shard's last sequence
    may be short; with ``split_tail`` it is cut at powers of two. A seed is searched with all its ids, or with the
    ``query_terms`` that weigh most in it. ``special``: see ``tokenize``.
    """
    small_batches(docs.sparkSession)
    tokens = cut(tokenize(docs, ranks, end_id, special))
    found = tokens.mapInArrow(_frequencies, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # at most vocabulary + 2 rows
    counts = {r["id"]: r["n"] for r in found}
    n_docs, n_ids = counts.pop(-1, 0), counts.pop(-2, 0)
    df = np.zeros(1 << 16)
    for i, n in counts.items():
        df[i] = n
    sc = docs.sparkSession.sparkContext
    shared, rank = sc.broadcast(np.log1p((n_docs - df + 0.5) / (df + 0.5))), sc.broadcast(ranks_of(df))
    mean = max(1.0, n_ids / max(1, n_docs))
    ranges = min(MOST_RANGES, max(1, -(-n_ids // shard_tokens)))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, key, size in _keyed(batches, rank.value):
            yield pa.record_batch({"key": pa.array([key.tobytes()], pa.binary()), "size": pa.array([size.tobytes()], pa.binary())})

    bounds = np.zeros(0, KEY)
    if ranges > 1:
        drawn = tokens.sample(min(1.0, max(LEAST_SAMPLE, RANGE_SAMPLE * ranges) / n_docs), seed=5).mapInArrow(sample, "key binary, size binary").collect()
        bounds = range_bounds(np.frombuffer(b"".join(r["key"] for r in drawn), KEY), np.frombuffer(b"".join(r["size"] for r in drawn), np.int64), ranges)
    cuts = sc.broadcast(bounds)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, key, _ in _keyed(batches, rank.value):
            part = np.searchsorted(cuts.value, key, "right") if len(cuts.value) else np.zeros(len(key), np.int64)
            sig, salt = ((key[k] ^ SIGN).view(np.int64) for k in KEY.names)  # signed, in the same order
            yield pa.record_batch({"range": pa.array(part, pa.int64()), "sig": pa.array(sig), "salt": pa.array(salt), "doc_id": batch.column("doc_id"), "ids": batch.column("ids")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by range, then key; a range that has grown to two shards gives its first half away."""
        held: deque[tuple[int | None, np.ndarray]] = deque()
        full, now, next_id = 0, -1, 0
        id_type = pa.int64()

        def packed(n: int) -> Iterator[pa.RecordBatch]:
            nonlocal next_id, full
            ids, docs = zip(*(held.popleft() for _ in range(n)), strict=True)
            full -= sum(map(len, docs))
            rows = []
            for w in Shard(list(docs), shared.value, mean, query_terms).windows(window):
                short = split_tail and sum(x[2] for x in w) < window
                for sequence in _powers_of_two(w) if short else (w,):
                    offset = 0
                    for d, at, k in sequence:
                        rows.append((ids[d], at, k, docs[d][at : at + k].astype("<u4").tobytes(), len(docs[d]), next_id, offset))
                        offset += k
                    next_id += 1
                if len(rows) >= 2000:
                    yield _batch(rows, id_type)
                    rows = []
            yield _batch(rows, id_type)

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for part, doc_id, raw in zip(batch.column("range").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                if part != now:
                    if held:
                        yield from packed(len(held))
                    now, next_id = part, part << 44
                ids = np.frombuffer(raw.as_py(), "<u2")
                if held and full + len(ids) >= 2 * shard_tokens:
                    ends = np.cumsum([len(d) for _, d in held])
                    yield from packed(max(1, int(np.searchsorted(ends, shard_tokens, "right"))))
                held.append((doc_id, ids))
                full += len(ids)
        if held:
            yield from packed(len(held))
        release()

    kind = tokens.dtypes[0][1]
    routed = tokens.mapInArrow(route, f"range long, sig long, salt long, doc_id {kind}, ids binary")
    tasks = ranges // RANGES_A_TASK
    dealt = routed.repartition(tasks, "range") if tasks > partitions(docs) else routed.repartition("range")
    return dealt.sortWithinPartitions("range", "sig", "salt").drop("sig", "salt").mapInArrow(run, f"doc_id {kind}, {OUT}")


def _batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    kinds = (id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    names = ["doc_id", *(c.split()[0] for c in OUT.split(", "))]
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.record_batch({k: pa.array(c, t) for k, t, c in zip(names, kinds, columns, strict=True)})


def ranks_path() -> str:
    """The public byte-level BPE's rank file, as installed on every node."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"), ranks_path())
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
