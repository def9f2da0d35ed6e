"""Language ID (5): script ranges, per-word scores, and Viterbi with a switching penalty over a text's words.

A word is a run of letters. Its score in a language is the sum of the log probabilities of its byte trigrams (word
ends are blanks), from tables of ``BUCKETS`` hashed trigrams per language; languages seldom written in the word's script
(by its first letter's range) are ruled out, unless all are. Viterbi labels the words with one switching penalty for
every change of language. A path with k stretches in other languages than the text's best single one changes k - 1
times at least; where no stretch of words gains half the penalty in any language, the best single language is the best
path (tested for all texts of a batch at once). The other texts are walked word by word, side by side. Runs of one label are spans; the language with most letters is the text's.

Models are fitted on about ``per_language`` labelled rows of each language, drawn by a hash of doc_id, so that the
rows read for training are bounded by that and the number of languages.

Defined results: null text, and text without letters, is ``und`` with score 0 and no spans; ties go to the language
first in order; without any labelled row all are ``und``; repeated rows are labelled alike; an empty table gives no
rows. Columns named like a result (lang_pred, score, spans) are replaced; other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackledger.llm.bpe import LETTER, byte_classes, code_points
from trackledger.llm.common import pieces, small_batches, table, words

BUCKETS = 1 << 15
PER_LANGUAGE = 2_500
PENALTY = 15.0
#: First code points of script ranges; what lies between is counted with the range before.
SCRIPTS = {"latin": 0x41, "greek": 0x370, "cyrillic": 0x400, "armenian": 0x530, "hebrew": 0x590, "arabic": 0x600, "indic": 0x900, "thai": 0xE00, "tibetan": 0xF00, "georgian": 0x10A0, "hangul": 0x1100, "ethiopic": 0x1200, "khmer": 0x1780, "latin_more": 0x1E00, "greek_more": 0x1F00, "kana": 0x3040, "han": 0x3400, "hangul_syllables": 0xAC00, "other": 0xD7B0}
_RANGES = np.array(list(SCRIPTS.values()))
#: Ranges of one script count as one.
_SCRIPT = np.array([{"latin_more": 0, "greek_more": 1, "hangul_syllables": 10}.get(name, i) for i, name in enumerate(SCRIPTS)])
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


class Words:
    """The words of a piece: bounds, documents, script, and the trigram bucket of every letter byte."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        letter = byte_classes(data) == LETTER if len(data) else np.zeros(0, bool)
        kind = np.zeros(256, bool)
        kind[1] = True
        self.start, self.end, self.doc = words(letter.view(np.uint8), offs, kind)
        self.script = _SCRIPT[np.maximum(np.searchsorted(_RANGES, code_points(data, self.start), "right") - 1, 0)] if len(self.start) else self.start
        # letters in lower case with a blank at both ends of each word; trigram i is centred on letter byte i
        self.letters = np.flatnonzero(letter)
        size = self.end - self.start
        b = _FOLD[data[self.letters]].astype(np.int64)
        ends = np.cumsum(size)
        left, right = np.append(32, b[:-1])[: len(b)], np.append(b[1:], 32)[: len(b)]
        left[ends - size], right[ends - 1] = 32, 32
        self.bucket = ((left * 65537 + b * 257 + right) * 0x9E3779B1 >> 13) & (BUCKETS - 1)
        self.size, self.ends = size, ends

    def sums(self, table: np.ndarray) -> np.ndarray:
        """(words, languages): sums of ``table`` (buckets, languages) over each word's trigrams."""
        return np.add.reduceat(table[self.bucket], self.ends - self.size, axis=0) if len(self.size) else np.zeros((0, table.shape[1]))


class Model:
    """Languages in order, log probabilities (buckets, languages), and which language is written in which script."""

    def __init__(self, names: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.names = names
        smooth = counts + 0.1
        self.table = np.log(smooth / smooth.sum(1, keepdims=True)).T.astype(np.float32).copy() if names else np.zeros((BUCKETS, 0), np.float32)
        share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
        rare = share < 0.005
        rare[:, rare.all(0)] = False
        self.bar = np.where(rare, -100.0, 0.0).T.astype(np.float32)

    def label(self, w: Words, n_docs: int, penalty: float) -> tuple[np.ndarray, np.ndarray]:
        """The language of every word, and each word's scores."""
        score = (w.sums(self.table) + self.bar[w.script]).astype(np.float64)
        n_lang = len(self.names)
        total = np.zeros((n_docs, n_lang))
        for k in range(n_lang):
            total[:, k] = np.bincount(w.doc, score[:, k], n_docs)
        best = total.argmax(1)
        label = best[w.doc]
        gain = score - score[np.arange(len(score)), label][:, None]
        sums = np.cumsum(gain, axis=0)
        # the most that a stretch gains: sum so far less the least sum before, documents kept apart by a falling offset
        first = np.searchsorted(w.doc, np.arange(n_docs))
        before = np.vstack([np.zeros((1, n_lang)), sums])[first[w.doc]]
        own = sums - before
        wide = np.abs(own).max(initial=0) * 2 + 1
        fall = -wide * w.doc[:, None]
        least = np.minimum.accumulate(np.minimum(own - gain, 0) + fall, axis=0) - fall
        # a little less, for the rounding of the sums: walking a text for nothing changes nothing
        mixed = np.unique(w.doc[(own - least > penalty / 2 - 1e-3).any(1)])
        walk(score, first[mixed], np.append(first, len(score))[mixed + 1], penalty, label)
        return label, score


def viterbi(score: np.ndarray, penalty: float) -> np.ndarray:
    """The labels of greatest summed score less ``penalty`` for every change."""
    n, k = score.shape
    came = np.empty((n, k), np.int32)
    value = score[0].copy()
    stay = np.arange(k)
    for t in range(1, n):
        top = int(value.argmax())
        switch = value[top] - penalty > value
        came[t] = np.where(switch, top, stay)
        value = np.where(switch, value[top] - penalty, value) + score[t]
    out = np.empty(n, np.int64)
    out[-1] = value.argmax()
    for t in range(n - 1, 0, -1):
        out[t - 1] = came[t, out[t]]
    return out


def walk(score: np.ndarray, starts: np.ndarray, ends: np.ndarray, penalty: float, label: np.ndarray) -> None:
    """``viterbi`` of the rows from each start to its end, into ``label``: one step moves all texts that have so many words."""
    if not len(starts):
        return
    order = np.argsort(starts - ends, kind="stable")  # the longest first: those still walked stay in front
    starts, size = starts[order], (ends - starts)[order]
    live = np.searchsorted(-size, -np.arange(size[0]))  # texts with more than t words
    came = np.empty(score.shape, np.int32)
    value = score[starts]
    stay = np.arange(score.shape[1])
    for t in range(1, size[0]):
        n = live[t]
        v = value[:n]
        top = v.argmax(1)
        switched = v[np.arange(n), top][:, None] - penalty
        switch = switched > v
        at = starts[:n] + t
        came[at] = np.where(switch, top[:, None], stay)
        value[:n] = np.where(switch, switched, v) + score[at]
    now = value.argmax(1)
    label[starts + size - 1] = now
    for t in range(size[0] - 1, 0, -1):
        n = live[t]
        at = starts[:n] + t
        now[:n] = came[at, now[:n]]
        label[at - 1] = now[:n]


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on rows (doc_id, text, lang) with text and lang: about ``per_language`` of each language."""
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    names = sorted(counts)
    if not names:
        return Model([], np.zeros((0, BUCKETS)), np.zeros((0, len(SCRIPTS))))
    share = F.create_map(*(x for k in names for x in (F.lit(k), F.lit(min(1.0, per_language / counts[k])))))
    drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
    width = BUCKETS + len(SCRIPTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for part, data, offs in pieces(batches):
            w = Words(data, offs)
            langs = np.array(part.column("lang").to_pylist(), object)
            for lang in set(langs):
                mine = (langs == lang)[w.doc]
                letters = np.repeat(mine, w.size)
                row = seen.setdefault(lang, np.zeros(width, np.int64))
                row[:BUCKETS] += np.bincount(w.bucket[letters], minlength=BUCKETS)
                row[BUCKETS:] += np.bincount(w.script[mine], minlength=len(SCRIPTS))
        if seen:
            yield pa.record_batch({"lang": pa.array(list(seen)), "counts": pa.array([x.tobytes() for x in seen.values()], pa.binary())})

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            for raw in batch.column("counts"):
                total += np.frombuffer(raw.as_buffer(), np.int64)
        yield pa.record_batch({"lang": pa.array([key[0].as_py()]), "counts": pa.array([total.tobytes()], pa.binary())})

    got = drawn.select("text", "lang").mapInArrow(count, "lang string, counts binary").groupBy("lang").applyInArrow(add, "lang string, counts binary").collect()
    found = {r["lang"]: np.frombuffer(bytes(r["counts"]), np.int64) for r in got}
    names = [k for k in names if k in found]
    m = np.array([found[k] for k in names]).reshape(len(names), width)
    return Model(names, m[:, :BUCKETS], m[:, BUCKETS:])


def identify(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """The columns of ``docs`` with lang_pred, score (0 to 1) and spans (array of start and end byte, lang)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    others = [c for c in docs.columns if c not in ("text", "lang_pred", "score", "spans")]
    docs = docs.select(*others, F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part, data, offs in pieces(batches):
            yield _labelled(part, data, offs, m, penalty)

    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + ", lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>"
    return docs.mapInArrow(run, schema)


def _labelled(part: pa.RecordBatch, data: np.ndarray, offs: np.ndarray, m: Model, penalty: float) -> pa.RecordBatch:
    n, w = part.num_rows, Words(data, offs)
    out = {c: part.column(c) for c in part.schema.names}
    if not m.names:
        return pa.record_batch(out | {"lang_pred": pa.array(["und"] * n), "score": pa.array(np.zeros(n)), "spans": pa.array([[]] * n, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])))})
    label, score = m.label(w, n, penalty)
    k = len(m.names)
    letters = np.bincount(w.doc * k + label, w.size, n * k).reshape(n, k)
    top, some = letters.argmax(1), letters.sum(1) > 0
    share = letters[np.arange(n), top] / np.maximum(letters.sum(1), 1)
    # how far the words' scores put the language before the next one, per word
    total = np.stack([np.bincount(w.doc, score[:, j], n) for j in range(k)], 1).astype(np.float64)
    mine = total[np.arange(n), top]
    total[np.arange(n), top] = -np.inf
    margin = (mine - total.max(1)) if k > 1 else np.full(n, 50.0)
    sure = 1 / (1 + np.exp(-np.clip(margin, -50, 50)))
    names = np.array(m.names, object)
    new = np.append(True, (label[1:] != label[:-1]) | (w.doc[1:] != w.doc[:-1]))[: len(label)]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(label))[: len(at)] - 1
    own = offs[w.doc[at]]
    bounds = np.append(0, np.cumsum(np.bincount(w.doc[at], minlength=n))).astype(np.int32)
    spans = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([pa.array(w.start[at] - own, pa.int64()), pa.array(w.end[last] - own, pa.int64()), pa.array(names[label[at]].tolist(), pa.string())], ["start", "end", "lang"]))
    return pa.record_batch(out | {"lang_pred": pa.array(np.where(some, names[top], "und").tolist(), pa.string()), "score": pa.array(np.where(some, share * sure, 0.0)), "spans": spans})


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op5_viterbi_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
