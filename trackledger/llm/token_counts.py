"""Token counts (12): pre-tokens that are known to be one token are counted by lookup, and only the rest is merged.

The proof is made once, on the driver, for a vocabulary file: every vocabulary string goes through the tokenizer's own merges,
and those that come out as one token, their own, form the table of whole tokens. It is as long as the vocabulary at most and is
broadcast with the file. A task cuts its texts into pre-tokens in numpy, keeps each distinct one of a piece once, looks it up in
the table, and gives only what isn't there to the tokenizer's merges (remembered up to a fixed number). One pass, no shuffle.

Strings of added tokens inside a text are one token each and cut the text, as the library does by default. Only byte-level BPE
files without normalizer, prefix blank, stripping or template are taken; others raise ``ValueError``.

Defined results: null or empty text has 0 bytes and 0 tokens; repeated rows and null ids are rows like others; an empty table
gives no rows; columns of ``docs`` named like a result are replaced.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from trackledger.llm.bpe import pieces_with, special_pattern
from trackledger.llm.common import pieces, small_batches, table

RESULTS = ("n_bytes", "n_tokens", "over_limit")


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: printable ones stand for themselves, others follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


def checked(text: str) -> dict:
    """The parsed tokenizer file, if it is of the kind that this module counts."""
    spec = json.loads(text)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    fits = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True) and model["type"] == "BPE"
    plain = not spec.get("normalizer") and not spec.get("post_processor") and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
    if not fits or not plain or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens", [])):
        raise ValueError("not a plain byte-level BPE file")
    return spec


def whole_tokens(text: str) -> list[bytes]:
    """Vocabulary strings (as bytes) that the file's own merges turn into one token: that string's."""
    tokenizer, back = Tokenizer.from_str(text), {c: b for b, c in byte_letters().items()}
    found = []
    for word, number in json.loads(text)["model"]["vocab"].items():
        if word and all(c in back for c in word):
            tokens = tokenizer.model.tokenize(word)
            if len(tokens) == 1 and tokens[0].id == number:
                found.append(bytes(back[c] for c in word))
    return found


class Counter:
    """Numbers of tokens of texts; ``whole`` is the proven table for the tokenizer file ``text``. Merged pieces are kept up to ``most``."""

    def __init__(self, text: str, whole: list[bytes], most: int = 200_000):
        self.model = Tokenizer.from_str(text).model
        self.whole = pa.array(whole, pa.binary())
        self.special = special_pattern([t["content"] for t in checked(text).get("added_tokens", [])])
        self.added = {t["content"].encode() for t in checked(text).get("added_tokens", [])}
        self.letters = byte_letters()
        self.known: dict[bytes, int] = {}
        self.most = most
        self.merged = 0

    def _merge(self, piece: bytes) -> int:
        if piece in self.added:  # only the special pattern cuts such a piece
            return 1
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= self.most:
                self.known = {}
            n = len(self.model.tokenize(piece.decode("latin-1").translate(self.letters)))
            self.merged += 1
            if len(piece) <= 256:
                self.known[piece] = n
        return n

    def count(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Tokens of every document of a piece."""
        starts = pieces_with(data, offs, self.special)
        if not len(starts):
            return np.zeros(len(offs) - 1, np.int64)
        bounds = np.append(starts, len(data)).astype(np.int32)
        column = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        coded = column.dictionary_encode()
        sizes = np.ones(len(coded.dictionary), np.int64)
        rest = np.flatnonzero(pc.is_null(pc.index_in(coded.dictionary, value_set=self.whole)).to_numpy(zero_copy_only=False))
        sizes[rest] = [self._merge(p) for p in coded.dictionary.take(pa.array(rest)).to_pylist()]
        before = np.append(0, np.cumsum(sizes[coded.indices.to_numpy()]))
        return np.diff(before[np.searchsorted(starts, offs, "left")])


#: A worker's counters, by the digest of the tokenizer file.
_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """The columns of ``docs`` but ``text``, with n_bytes, n_tokens, and over_limit where a text has more than ``limit`` tokens."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    checked(text)
    small_batches(docs.sparkSession)
    digest = hashlib.sha256(text.encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast((text, whole_tokens(text)))  # as long as the vocabulary file at most
    others = [c for c in docs.columns if c not in ("text", *RESULTS)]
    docs = docs.select(*others, docs["text"].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if digest not in _counters:
            _counters[digest] = Counter(*shared.value)
        for part, data, offs in pieces(batches):
            n = _counters[digest].count(data, offs)
            counted = {"n_bytes": pa.array(np.diff(offs)), "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)}
            yield pa.record_batch({c: part.column(c) for c in others} | counted)

    schema = "".join(f"`{n}` {t}, " for n, t in docs.select(*others).dtypes) + "n_bytes long, n_tokens long, over_limit boolean"
    return docs.mapInArrow(run, schema)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
