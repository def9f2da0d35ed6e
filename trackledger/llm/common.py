"""What several training-data operators share: tables cut from their lineage, row ids, and numpy over Arrow text.

Text is handled as whole Arrow buffers (``mapInArrow``): a *piece* of a batch is a run of documents of
about ``PIECE`` bytes, and all hashing below works on the piece's bytes at once. Null text counts as empty.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE = 1 << 20
U64 = np.uint64


# ---------------------------------------------------------------- Spark side
def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only where all is one process (tests) may the session name none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_recorded: ContextVar[list[str] | None] = ContextVar("recorded", default=None)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps start from files that outlive executors."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if (made := _recorded.get()) is not None:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that ``cut`` wrote, and forget them."""
    sc = spark.sparkContext
    while paths:
        path = sc._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of all tables that are cut inside."""
    made: list[str] = []
    token = _recorded.set(made)
    try:
        yield made
    finally:
        _recorded.reset(token)


def finished(spark: SparkSession, work: Callable[[], DataFrame]) -> DataFrame:
    """The result of ``work``, written; the tables that it cut on the way are deleted."""
    with recorded() as made:
        try:
            result = work()
            with recorded() as last:
                result = cut(result)
        finally:
            drop_tables(spark, made)
    keep(last)
    return result


def keep(paths: list[str]) -> None:
    """Tables that outlive the block they were cut in: the one around it records them, if there is one."""
    if (outer := _recorded.get()) is not None:
        outer.extend(paths)


def with_row_id(df: DataFrame, name: str = "_rid") -> DataFrame:
    """Number the rows, so that they stay apart even where doc_id repeats or is null.

    Rows and numbers are written once: a number holds the file partition, and another scan may be split otherwise
    (the size of splits follows the cores that are registered), so no later job may number the rows again.
    """
    return cut(df.withColumn(name, F.monotonically_increasing_id()))


def with_chunks(df: DataFrame, size: int = 4 << 20) -> DataFrame:
    """``with_row_id`` (_rid), and for runs of rows with about ``size`` bytes of ``text`` the number of their first row (_chunk)."""
    numbered = df.withColumn("_rid", F.monotonically_increasing_id())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, full = -1, 0
        for batch in batches:
            offs, rid = text_buffer(batch.column("text"))[1], batch.column("_rid").to_numpy()
            chunk, at, n = np.empty(len(rid), np.int64), 0, len(rid)
            while at < n:
                if first < 0 or full >= size:
                    first, full = int(rid[at]), 0
                end = min(n, max(at + 1, int(np.searchsorted(offs, offs[at] + size - full, "right"))))
                chunk[at:end] = first
                full += int(offs[end] - offs[at])
                at = end
            yield batch.append_column("_chunk", pa.array(chunk))

    schema = ", ".join(f"`{n}` {t}" for n, t in numbered.dtypes) + ", _chunk long"
    return cut(numbered.mapInArrow(deal, schema))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Texts go to Python in batches of so many rows at most, unless the session has chosen a number itself."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def partitions(df: DataFrame, least: int = 1) -> int:
    """As many partitions as the session shuffles into, or ``least`` if that is more."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


# ---------------------------------------------------------------- Arrow side
def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows."""
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = PIECE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``size`` bytes (a longer document stands alone), with the bytes and offsets of ``column``."""
    try:
        for batch in batches:
            data, offs = text_buffer(batch.column(column))
            at, n = 0, len(offs) - 1
            while at < n:
                end = max(at + 1, int(np.searchsorted(offs, offs[at] + size, "right")) - 1)
                end = min(end, at + 4096)
                yield batch.slice(at, end - at), data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
                at = end
    finally:
        release()


def release() -> None:
    """Give freed memory back to the system: workers are kept for later tasks, and theirs counts as the executor's."""
    gc.collect()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def binary_column(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


# ---------------------------------------------------------------- hashing
def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: What every byte becomes where A-Z count as a-z.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Of eight bytes the first 0 to 7.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(8)], U64)
#: Spans beyond so many bytes are hashed one by one.
LONG_SPAN = 4096
#: Bytes of words: all but white space; and ASCII digits, letters and all non-ASCII bytes.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACE
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def words(data: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word (maximal run of bytes of ``kind`` within a document) and its document's number."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    is_word = kind[data]
    edge = offs[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    before = np.empty_like(is_word)
    before[0], before[1:] = False, is_word[:-1]
    before[edge] = False
    after = np.empty_like(is_word)
    after[-1], after[:-1] = False, is_word[1:]
    after[edge - 1] = False
    starts = np.flatnonzero(is_word & ~before)
    ends = np.flatnonzero(is_word & ~after) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True, seed: int = 7) -> np.ndarray:
    """A 64-bit hash of the bytes of every span; with ``lower``, A-Z count as a-z.

    Eight bytes at a time are mixed into the state of all spans that go on; the mixing isn't linear, so no pattern of bytes
    collides by its form. Other seeds give independent hashes.
    """
    size = ends - starts
    state = mix(size.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(seed))
    if not len(data) or not len(starts):
        return state
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = FOLD[data] if lower else data
    word = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    live = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
    at, left, h = starts[live], size[live], state[live]
    while len(live):
        w = word[at]
        short = np.flatnonzero(left < 8)
        w[short] &= _FIRST[left[short]]
        h = mix(h ^ w * U64(0xD6E8FEB86659FD93))
        more = left > 8
        state[live[~more]] = h[~more]
        live, at, left, h = live[more], at[more] + 8, left[more] - 8, h[more]
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        state[i] = int.from_bytes(hashlib.blake2b(padded[starts[i] : ends[i]].tobytes(), digest_size=8, key=seed.to_bytes(8, "little")).digest(), "little")
    return state


def shingles(hashes: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> list[np.ndarray]:
    """For each document the sorted distinct hashes of its runs of k words; of 1 to k - 1 words, one hash for all of them."""
    bounds = np.searchsorted(doc, np.arange(n_docs + 1))
    n = len(hashes)
    out: list[np.ndarray] = []
    runs = np.zeros(max(0, n - k + 1), U64)
    for j in range(k):
        runs = runs * U64(0xD6E8FEB86659FD93) + hashes[j : n - k + 1 + j] if len(runs) else runs
    runs = mix(runs)
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if e - s >= k:
            u = np.sort(runs[s : e - k + 1])
            out.append(u[np.concatenate(([True], u[1:] != u[:-1]))])
        elif e > s:
            h = U64(e - s)
            with np.errstate(over="ignore"):
                for x in hashes[s:e]:
                    h = h * U64(0xA0761D6478BD642F) + x
            out.append(mix(np.array([h], U64)))
        else:
            out.append(np.zeros(0, U64))
    return out


# ---------------------------------------------------------------- Bloom filters
def bloom_set(packed: np.ndarray, hashes: np.ndarray, k: int = 2) -> None:
    """Set the k bits of each hash in ``packed``, eight bits a byte; the number of bits is a power of two."""
    if not len(hashes):
        return
    at = np.sort(np.concatenate(list(bloom_at(len(packed) * 8, hashes, k))))
    byte = at >> 3
    first = np.flatnonzero(np.append(True, byte[1:] != byte[:-1]))
    packed[byte[first]] |= np.bitwise_or.reduceat((128 >> (at & 7)).astype(np.uint8), first)


def bloom_has(packed: np.ndarray, hashes: np.ndarray, k: int = 2) -> np.ndarray:
    """Which hashes have all their bits set."""
    found = np.ones(len(hashes), bool)
    for at in bloom_at(len(packed) * 8, hashes, k):
        found &= (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return found


def bloom_at(size: int, hashes: np.ndarray, k: int) -> Iterator[np.ndarray]:
    for i in range(k):
        yield (mix(hashes + U64(i * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)) & U64(size - 1)).astype(np.int64)
