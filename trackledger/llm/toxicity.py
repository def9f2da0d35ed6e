"""Toxicity (9): a logistic classifier with a counterfactual penalty.

Features of a text are its distinct words and four-byte word beginnings, as 64-bit hashes. The classifier is fitted on
at most ``sample_rows`` labelled documents (drawn by a hash of doc_id; only their feature hashes reach the driver): features
that tell the classes apart by a G test are kept, and weights minimise the logistic loss, a ridge, and for every labelled
sentence with an identity term the squared change of its score when that term is swapped for each other term or a
neutral word of its language. Terms thus share one weight, near that of the neutral words, and neutral mentions of a group stay low.
All whole texts are then scored in one pass without a shuffle.

Defined results: null and empty texts have no features and get the base score; a null label is no label; a document
with several labels has their mean, 0.5 or more counting as 1; of rows with one doc_id the least text is learned from;
repeated rows are scored alike; without labels of both
kinds every score is the share of label 1 (0 without labels); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackledger.llm.common import ALNUM, U64, mix, pieces, release, small_batches, span_hashes, table, words

SAMPLE_ROWS = 12_000
PREFIX = 4
#: By language, terms whose exchange should not move a score, and neutral words that they are also exchanged for.
IDENTITY_TERMS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "en": (("women", "men", "muslims", "christians", "jews", "hindus", "atheists", "gay", "lesbian", "straight", "transgender", "black", "white", "asian", "latino", "african", "european", "immigrants", "refugees", "disabled", "deaf", "blind", "elderly", "young"), ("people", "persons")),
    "de": (("frauen", "männer", "muslime", "christen", "juden", "atheisten", "schwule", "lesben", "schwarze", "weiße", "asiaten", "ausländer", "flüchtlinge", "behinderte", "blinde", "alte", "junge"), ("menschen", "leute")),
    "fr": (("femmes", "hommes", "musulmans", "chrétiens", "juifs", "athées", "gays", "lesbiennes", "noirs", "blancs", "asiatiques", "étrangers", "réfugiés", "handicapés", "aveugles", "vieux", "jeunes"), ("gens", "personnes")),
    "es": (("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "ateos", "gais", "lesbianas", "negros", "blancos", "asiáticos", "extranjeros", "refugiados", "discapacitados", "ciegos", "viejos", "jóvenes"), ("gente", "personas")),
}
# End of fixed values.
Groups = dict[str, tuple[tuple[str, ...], tuple[str, ...]]]


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and of words' beginnings, and their documents."""
    start, end, doc = words(data, offs, ALNUM)
    h = span_hashes(data, start, end)
    longer = end - start > PREFIX
    p = mix(span_hashes(data, start[longer], start[longer] + PREFIX) ^ U64(0x5851F42D4C957F2D))
    return np.concatenate([h, p]), np.concatenate([doc, doc[longer]])


def term_features(term: str) -> np.ndarray:
    raw = np.frombuffer(term.encode(), np.uint8)
    return features(raw, np.array([0, len(raw)]))[0]


class Model:
    """Sorted feature hashes, their weights and the base; ``mentions``: labelled sentences whose terms were swapped, by term."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, base: float, mentions: dict[str, int] | None = None):
        self.keys, self.weights, self.base, self.mentions = keys, weights, base, mentions or {}
        self.first = np.zeros(1 << 16, bool)
        self.first[(keys >> U64(48)).astype(np.int64)] = True

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        logit = np.full(len(offs) - 1, self.base)
        if len(self.keys):
            h, doc = features(data, offs)
            at = np.flatnonzero(self.first[(h >> U64(48)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
            hit = self.keys[place] == h[at]
            pair = np.unique(doc[at[hit]] * len(self.keys) + place[hit])
            logit += np.bincount(pair // len(self.keys), self.weights[pair % len(self.keys)], len(offs) - 1)
        return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def fit(found: list[np.ndarray], y: np.ndarray, mentions: dict[str, int], groups: Groups, ridge: float | None = None, swap: float = 1.0, g_least: float = 12.0) -> Model:
    """``found``: each labelled document's distinct features; ``mentions``: labelled sentences that hold each term."""
    every = [t for terms, neutral in groups.values() for t in (*terms, *neutral)]
    none = np.zeros(0, U64)
    ridge = max(2e-5, 0.1 / max(1, len(y))) if ridge is None else ridge  # small samples hold more features by chance
    if not len(y) or y.min() == y.max():
        p = min(max(float(y.mean()) if len(y) else 0.0, 1e-6), 1 - 1e-6)
        return Model(none, np.zeros(0), float(np.log(p / (1 - p))))
    size = np.fromiter(map(len, found), np.int64, len(found))
    if not size.sum():
        return Model(none, np.zeros(0), float(np.log(y.mean() / (1 - y.mean()))))
    flat, doc = np.concatenate([none, *found]), np.repeat(np.arange(len(found), dtype=np.int32), size)
    found.clear()
    ranked = np.sort(flat)
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    n = np.diff(np.append(first, len(ranked)))
    known = n >= 3
    distinct, there = ranked[first], {}
    for t in every:
        x = term_features(t)
        place = np.minimum(np.searchsorted(distinct, x), len(distinct) - 1)
        if (distinct[place] == x).all():  # the word itself, not its beginning alone
            there[t] = x
            known[place] = True
    keys, n = distinct[known], n[known]
    del ranked, first, distinct
    if not len(keys):
        return Model(none, np.zeros(0), float(np.log(y.mean() / (1 - y.mean()))))
    at = np.minimum(np.searchsorted(keys, flat), len(keys) - 1)
    hit = keys[at] == flat
    at, doc = at[hit].astype(np.int32), doc[hit]
    del flat, hit
    ones = np.bincount(at, y[doc], len(keys))
    share = y.mean()

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / expected), 0)

    g = 2 * (part(ones, n * share) + part(n - ones, n * (1 - share)))
    swaps = {t: np.searchsorted(keys, np.unique(x)) for t, x in there.items()}
    keep = np.zeros(len(keys), bool)
    keep[(n >= 3) & (g >= g_least)] = True
    for x in swaps.values():
        keep[x] = True
    new = np.cumsum(keep) - 1
    use = keep[at]
    col, row, k = new[at[use]], doc[use], int(keep.sum())
    w, b = np.zeros(k), float(np.log(share / (1 - share)))
    pairs = []
    for terms, neutral in groups.values():
        for t in set(terms) & set(mentions) & set(swaps):
            for other in (*terms, *neutral):
                if other != t:
                    d = np.zeros(k)
                    d[new[swaps[t]]] += 1
                    if other in swaps:  # else the sample doesn't know it, and it weighs nothing
                        d[new[swaps[other]]] -= 1
                    pairs.append((mentions[t] / (len(terms) + len(neutral) - 1) / len(y), d))
    change = np.array([d for _, d in pairs]).reshape(len(pairs), k)
    much = np.array([c for c, _ in pairs])
    m = v = np.zeros(k + 1)
    for step in range(1, 401):  # Adam over the whole sample
        logit = b + np.bincount(row, w[col], len(y))
        gap = 1 / (1 + np.exp(-np.clip(logit, -60, 60))) - y
        grad = np.append(np.bincount(col, gap[row], k) / len(y) + ridge * w + 2 * swap * (change.T @ (much * (change @ w))), gap.mean())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return Model(keys[keep], w, float(b), {t: n for t, n in mentions.items() if t in swaps})


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, groups: Groups = IDENTITY_TERMS, **options: float | None) -> Model:
    """Fit on ``labels`` (doc_id, toxic): at most ``sample_rows`` of them, so what is broadcast and collected is bounded.

    ``groups``: for each language its identity terms and neutral words; a term is swapped for those of its own language.
    """
    small_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    hashes = {int(term_features(t)[0]): t for terms, _ in groups.values() for t in terms}  # that of the word comes first

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sought = np.array(sorted(hashes), U64)
        for part, data, offs in pieces(batches):
            h, doc = features(data, offs)
            start, end, word_doc = words(data, offs, ALNUM)
            own = h[: len(start)]
            # sentences end at . ! ? or a line break
            stops = np.flatnonzero(np.isin(data, np.frombuffer(b".!?\n", np.uint8)))
            sentence = np.searchsorted(stops, start)
            hit = np.isin(own, sought)
            lists, held = [], []
            order = np.lexsort((h, doc))
            hs, ds = h[order], doc[order]
            new = np.append(True, (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1]))[: len(hs)]
            hs, ds = hs[new], ds[new]
            bounds = np.searchsorted(ds, np.arange(part.num_rows + 1))
            for i in range(part.num_rows):
                lists.append(hs[bounds[i] : bounds[i + 1]].tobytes())
                mine = hit & (word_doc == i) if hit.any() else hit
                held.append([hashes[int(x)] for x in np.unique(np.stack([sentence[mine].astype(U64), own[mine]]), axis=1)[1]] if mine.any() else [])
            yield pa.record_batch({"y": part.column("y"), "f": pa.array(lists, pa.binary()), "terms": pa.array(held, pa.list_(pa.string()))})

    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    # of rows with one doc_id the least text counts: no more rows than were chosen
    sample = sample.groupBy("doc_id").agg(F.min("y").alias("y"), F.min("text").alias("text")).select("y", "text")
    got = sample.mapInArrow(read, "y int, f binary, terms array<string>").toArrow()
    y = got.column("y").to_numpy().astype(np.float64)
    found = [np.frombuffer(x.as_buffer(), U64).copy() for x in got.column("f")]
    mentions: dict[str, int] = {}
    for some in got.column("terms").to_pylist():
        for t in some:
            mentions[t] = mentions.get(t, 0) + 1
    del got
    model = fit(found, y, mentions, groups, **options)
    release()
    return model


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of ``docs`` and ``score`` (0 to 1; a column of that name is replaced)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    others = [c for c in docs.columns if c not in ("text", "score")]
    docs = docs.select(*others, F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in pieces(batches):
            yield pa.record_batch({c: part.column(c) for c in part.schema.names} | {"score": pa.array(shared.value.score(data, offs))})

    return docs.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + ", score double")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op9_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = train(docs, labels.where(~held_out()))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
