"""How often each shingle of a corpus occurs, told to the chunks of documents that hold it.

1. A task gathers the distinct hashes of a chunk (a few megabytes of text) with their counts, and sends them off by hash
   range, sorted, as compressed differences: some two bytes a hash.
2. A range adds the counts up and answers every chunk with those of its hashes that occur twice or more, and how often.

A chunk sends a hash once, so no hash is heavier than the number of chunks. Ranges and the hashes' bits follow the size
of the corpus; nothing is broadcast, nothing reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trackledger.llm.common import U64, pieces

CODEC = pa.Codec("zstd", compression_level=1)
MOST_COUNT = 65_535
#: Chunks (of about a million shingles) that one range is planned for.
RANGE_CHUNKS = 3


def squeezed(raw: bytes) -> bytes:
    return CODEC.compress(raw, asbytes=True)


def opened(raw: bytes, size: int) -> bytes:
    return CODEC.decompress(raw, size, asbytes=True)


def packed(h: np.ndarray, width: int) -> bytes:
    """Rising numbers below 2**(8 * width) as differences, compressed by place of byte."""
    planes = np.diff(h, prepend=U64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return squeezed(np.ascontiguousarray(planes).tobytes())


def unpacked(raw: bytes, n: int, width: int) -> np.ndarray:
    planes = np.frombuffer(opened(raw, n * width), np.uint8).reshape(width, n)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = planes.T
    return np.cumsum(wide.view("<u8").ravel(), dtype=U64)


def level_of(df: np.ndarray) -> np.ndarray:
    """Four times the binary logarithm of a frequency, rounded up, in a byte."""
    return np.ceil(4 * np.log2(df)).astype(np.uint8)


class Frequencies:
    """The plan for a corpus of ``n_chunks`` chunks: how many bits of a hash count, and how many ranges there are."""

    def __init__(self, n_chunks: int):
        self.bits = min(64, max(36, 28 + n_chunks.bit_length()))  # some 2**20 shingles a chunk, 2**8 values for each
        self.width, self.shift = -(-self.bits // 8), U64(64 - self.bits)
        self.ranges = max(1, -(-n_chunks // RANGE_CHUNKS))

    def short(self, h: np.ndarray) -> np.ndarray:
        return h >> self.shift

    def range_of(self, h: np.ndarray) -> np.ndarray:
        return ((h >> U64(self.bits - 32)) * U64(self.ranges)) >> U64(32)

    def levels(self, docs: DataFrame, hashes: Callable[[np.ndarray, np.ndarray], list[np.ndarray]]) -> DataFrame:
        """(chunk, n, tokens, level) of ``docs`` (_chunk, text): a chunk's hashes that occur in two documents or more, by range.

        ``hashes`` gives each document's distinct hashes from (bytes, offsets). Rows of a chunk lie together.
        """
        width = self.width

        def tell(chunk: int, held: list[np.ndarray]) -> pa.RecordBatch:
            h = np.sort(self.short(np.concatenate(held)))
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
            n = np.minimum(np.diff(np.append(first, len(h))), MOST_COUNT).astype("<u2")
            h = h[first]
            r = self.range_of(h)
            edge = np.flatnonzero(np.append(True, r[1:] != r[:-1])[: len(r)])
            spans = list(zip(edge.tolist(), [*edge[1:].tolist(), len(h)], strict=True)) if len(h) else []
            return pa.record_batch({
                "r": pa.array(r[edge].astype(np.int64)), "chunk": pa.array(np.full(len(edge), chunk, np.int64)), "n": pa.array([b - a for a, b in spans], pa.int32()),
                "tokens": pa.array([packed(h[a:b], width) for a, b in spans], pa.binary()), "counts": pa.array([squeezed(n[a:b].tobytes()) for a, b in spans], pa.binary()),
            })

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, held = -1, []
            for part, data, offs in pieces(batches):
                chunk, found = part.column("_chunk").to_numpy(), hashes(data, offs)
                edge = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1]))
                for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(chunk)], strict=True):
                    if held and chunk[a] != own:
                        yield tell(own, held)
                        held = []
                    own = int(chunk[a])
                    held += found[a:b]
            if held:
                yield tell(own, held)

        def answer(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chunk, tokens, counts = [], [], []
            for batch in batches:
                for c, n, t, m in zip(*(batch.column(x).to_pylist() for x in ("chunk", "n", "tokens", "counts")), strict=True):
                    chunk.append(c)
                    tokens.append(unpacked(t, n, width))
                    counts.append(np.frombuffer(opened(m, 2 * n), "<u2"))
            ends = np.cumsum([len(t) for t in tokens])
            flat = np.concatenate(tokens)
            tokens.clear()
            order = np.argsort(flat, kind="stable")
            ranked = flat[order]
            first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
            df = np.add.reduceat(np.concatenate(counts).astype(np.int64)[order], first)
            level = np.empty(len(flat), np.uint8)
            level[order] = np.repeat(level_of(df), np.diff(np.append(first, len(flat))))
            for c, a, b in zip(chunk, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                keep = np.flatnonzero(level[a:b]) + a
                if len(keep):
                    yield pa.record_batch({"chunk": pa.array([c]), "n": pa.array([len(keep)], pa.int32()), "tokens": pa.array([packed(flat[keep], width)], pa.binary()), "level": pa.array([squeezed(level[keep].tobytes())], pa.binary())})

        sent = docs.select("_chunk", "text").mapInArrow(count, "r long, chunk long, n int, tokens binary, counts binary")
        return sent.groupBy("r").applyInArrow(answer, "chunk long, n int, tokens binary, level binary")

    def looked_up(self, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """A chunk's rising hashes (short) and their levels."""
        n, raw, level = (answers.column(c).to_pylist() for c in ("n", "tokens", "level"))
        got = sorted(((unpacked(t, m, self.width), np.frombuffer(opened(x, m), np.uint8)) for m, t, x in zip(n, raw, level, strict=True)), key=lambda p: int(p[0][0]))
        return np.concatenate([np.zeros(0, U64), *(t for t, _ in got)]), np.concatenate([np.zeros(0, np.uint8), *(x for _, x in got)])


def levels_at(known: np.ndarray, level: np.ndarray, short: np.ndarray) -> np.ndarray:
    """Levels of hashes; 0 where a hash occurs once."""
    if not len(known):
        return np.zeros(len(short), np.uint8)
    at = np.minimum(np.searchsorted(known, short), len(known) - 1)
    return np.where(known[at] == short, level[at], 0).astype(np.uint8)
