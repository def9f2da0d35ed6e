"""Hashes seen once and seen again: two Bloom filters, filled by tasks and merged by slices."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackledger.llm.common import bloom_has, bloom_set, pieces, release

#: Bits of a slice at least, and slices of a filter at most.
SLICE, MOST_SLICES = 1 << 16, 512
#: Bits of a filter: 64 MB is the most that is broadcast.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 29


def filter_size(docs: DataFrame, per_byte: float) -> int:
    """Bits for the texts of ``docs``: a power of two, at least ``per_byte`` for each byte of text, up to ``MOST_BITS``."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # one row
    return min(MOST_BITS, max(LEAST_BITS, 1 << int(size * per_byte).bit_length()))


def twice_filter(docs: DataFrame, hashes: Callable[[np.ndarray, np.ndarray], np.ndarray], bits: int) -> np.ndarray:
    """The packed filter of all hashes that occur twice or more (and, as Bloom filters do, some others).

    ``bits`` is a power of two. ``hashes`` gives those of a piece (bytes, offsets) of the texts. ``bits / 8`` bytes reach the driver, whatever the input;
    two tasks' filters merge into: seen twice by either, or once by both.
    """

    width = min(bits, max(SLICE, bits // MOST_SLICES))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for _, data, offs in pieces(batches):
            h = np.sort(hashes(data, offs))
            new = np.append(True, h[1:] != h[:-1])[: len(h)]
            bloom_set(twice, np.unique(h[~new]))
            h = h[new]
            bloom_set(twice, h[bloom_has(once, h)])
            bloom_set(once, h)
        for i in range(bits // width):
            part = slice(i * width // 8, (i + 1) * width // 8)
            if once[part].any():
                a, b = (zlib.compress(x[part].tobytes(), 1) for x in (once, twice))
                yield pa.record_batch({"slice": pa.array([i], pa.int32()), "once": pa.array([a], pa.binary()), "twice": pa.array([b], pa.binary())})

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = twice = np.zeros(width // 8, np.uint8)
        for batch in batches:
            for a, b in zip(batch.column("once").to_pylist(), batch.column("twice").to_pylist(), strict=True):
                a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
                once, twice = once | a, twice | b | (once & a)
        yield pa.record_batch({"slice": pa.array([key[0].as_py()], pa.int32()), "twice": pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary())})

    parts = docs.select("text").mapInArrow(fill, "slice int, once binary, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.groupBy("slice").applyInArrow(merge, "slice int, twice binary").collect():
        part = np.frombuffer(zlib.decompress(bytes(r["twice"])), np.uint8)
        out[r["slice"] * width // 8 :][: len(part)] = part
    release()
    return out
