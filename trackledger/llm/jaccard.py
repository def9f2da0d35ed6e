"""N-gram Jaccard join (6): adaptive multi-match prefixes, exact verification, components.

A document is its set of distinct k-word shingles (64-bit hashes, 128 bits for a whole set). Equal sets are one node, named
by its smallest row number.

1. *Order.* Every shingle's frequency in the corpus is counted by hash range and told to the chunks of documents that hold
   it (``frequency``); it orders shingles, rare first.
2. *Prefixes.* Two sets that reach the threshold t share l of their first n - ceil(t n) + l shingles, for any l. A set
   starts with l = 1 and lengthens its prefix, up to ``MOST_MATCHES``, by the estimated number of sets that its prefix
   meets; a pair must share as many prefix shingles as the smaller l of the two. Pairs are sought by the prefix for l = 1,
   less the shingles that occur once: most documents have nothing left.
3. *Candidates.* Prefix entries with a parity sketch of their set meet by shingle in bins of bounded size. A pair passes if
   sizes and the sketches' difference (never more than the sets') allow the threshold; a bin returns a spanning forest of
   the pairs that pass, always to the smallest row number, so that bins agree. Those whose prefixes share too little go.
   A shingle with more than ``BLOCK`` sets is cut into blocks that are first searched by themselves, then by one set for each
   component found.
4. *Verification* compares the shingles of whole texts, which travel once to the text that they are compared with. Verified links
   make components; then shingles whose sets are still in different components are asked again, for all pairs that pass
   between these. Links inside a component change nothing, so components are exact. Of a shingle with more than ``BLOCK`` sets
   the largest component is dealt out and all others go to each of its blocks.

Defined results: null text and text without words have an empty set and link with nothing; texts of fewer than k words
are one shingle; repeated rows are copies of one node; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackledger.llm.common import NOT_SPACE, U64, cut, finished, pieces, release, shingles, small_batches, span_hashes, table, with_chunks, words
from trackledger.llm.components import components
from trackledger.llm.frequency import Frequencies, levels_at, opened, squeezed

MOST_MATCHES = 4
BLOCK = 2048
BIN_ROWS = 30_000
#: Texts compared with one other in a row, and texts of a task that compares them.
HUB, TASK_SETS = 256, 200
SKETCH_BITS = (128, 16_384)


def sets_of(data: np.ndarray, offs: np.ndarray, k: int) -> list[np.ndarray]:
    start, end, doc = words(data, offs, NOT_SPACE)
    return shingles(span_hashes(data, start, end), doc, len(offs) - 1, k)


class Threshold:
    """Jaccard of at least num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def prefix(self, n: int, matches: int) -> int:
        return min(n, n - -(-self.num * n // self.den) + matches)

    def overlap(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return -(-self.num * (a + b) // (self.num + self.den))

    def sketch_bits(self, n: int) -> int:
        """A power of two, four times as many as shingles in which two linked sets of this size may differ."""
        low, high = SKETCH_BITS
        return min(high, max(low, 1 << (8 * (n - int(self.overlap(n, n)))).bit_length()))

    def same(self, x: np.ndarray, y: np.ndarray) -> bool:
        """Whether two sets (rising hashes) reach the threshold."""
        if len(x) > len(y):
            x, y = y, x
        common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
        return self.den * common >= self.num * (len(x) + len(y) - common)


def sketch(u: np.ndarray, bits: int) -> bytes:
    """Parities of hashed shingle counts: two sketches differ in no more bits than their sets in shingles."""
    return np.packbits((np.bincount((u >> U64(40)).astype(np.int64) & (bits - 1), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(raw: list[bytes], width: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For every width the sketches of that width or more, folded to it: rows' places, and their 64-bit words."""
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    w, last = int(width.max()), np.zeros((0, 0), U64)
    while w >= int(width.min()):
        rows = np.flatnonzero(width >= w)
        values = np.zeros((len(rows), w // 64), U64)
        own = width[rows] == w
        if own.any():
            values[own] = np.frombuffer(b"".join(raw[i] for i in rows[own].tolist()), U64).reshape(-1, w // 64)
        if len(last):
            values[~own] = last[:, : w // 64] ^ last[:, w // 64 :]
        place = np.full(len(width), -1)
        place[rows] = np.arange(len(rows))
        out[w], last = (place, values), values
        w //= 2
    return out


def ordered_prefix(u: np.ndarray, level: np.ndarray, t: Threshold) -> tuple[np.ndarray, np.ndarray, int]:
    """The set's lengthened prefix, the shingles by which it is sought, and its number of matches.

    ``level`` is four times the binary logarithm of each shingle's frequency, 0 for those that occur once.
    """
    by = np.argsort(level, kind="stable")
    first = t.prefix(len(u), 1)
    own = level[by[:first]]
    cost = float((np.exp2(own / 4.0) - 1).sum()) / first
    matches = 1 + min(MOST_MATCHES - 1, int(np.log2(1 + cost / 32)))
    while matches > 1 and t.prefix(len(u), matches) - first < matches - 1:
        matches -= 1  # the set is too small
    return u[by[: t.prefix(len(u), matches)]], u[by[:first][own > 0]], matches


def spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of edges that span the components of numbered nodes; of a node's edges that to the smallest number goes first."""
    n = int(max(a.max(), b.max())) + 1
    label, live, chosen = np.arange(n), np.arange(len(a)), []
    while True:
        x, y = label[a[live]], label[b[live]]
        keep = x != y
        live, x, y = live[keep], x[keep], y[keep]
        if not len(live):
            return np.concatenate([np.zeros(0, np.int64), *chosen])
        order = np.lexsort((np.minimum(x, y), np.maximum(x, y)))
        live, x, y = live[order], x[order], y[order]
        high, at = np.unique(np.maximum(x, y), return_index=True)
        chosen.append(live[at])
        label[high] = np.minimum(x, y)[at]
        while not np.array_equal(up := label[label], label):
            label = up


def passing(t: pa.Table, threshold: Threshold, all_pairs: bool) -> pa.Table:
    """Pairs of one bin whose sizes and sketches allow the threshold; rows are (token, rid, n, sk, side, comp)."""
    t = t.combine_chunks().sort_by([("token", "ascending"), ("n", "ascending"), ("rid", "ascending")])
    token, rid, n, side, comp = (t.column(c).to_numpy() for c in ("token", "rid", "n", "side", "comp"))
    node, name = np.unique(rid, return_inverse=True)
    sides = len(np.unique(side)) > 1
    raw = t.column("sk").to_pylist()
    width = np.fromiter(map(len, raw), np.int64, len(raw)) * 8
    by_width = folded(raw, width)
    # partners of a row: later rows of its shingle, up to the largest size
    end = np.empty(len(token), np.int64)
    bounds = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    for s, e in zip(bounds.tolist(), [*bounds[1:].tolist(), len(token)], strict=True):
        end[s:e] = s + np.searchsorted(n[s:e], n[s:e] * threshold.den // threshold.num, "right")
    more = np.maximum(end - np.arange(len(token)) - 1, 0)
    got_a, got_b = [], []
    total = np.cumsum(more)
    row = 0
    while row < len(token):
        stop = max(row + 1, int(np.searchsorted(total, (total[row - 1] if row else 0) + 500_000, "right")))
        i = np.repeat(np.arange(row, stop), more[row:stop])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(more[row:stop]) - more[row:stop], more[row:stop])
        ok = comp[i] != comp[j]
        if sides:
            ok &= side[i] != side[j]
        i, j = i[ok], j[ok]
        most = n[i] + n[j] - 2 * threshold.overlap(n[i], n[j])
        least = np.minimum(width[i], width[j])
        ok = np.zeros(len(i), bool)
        for w, (place, values) in by_width.items():
            at = np.flatnonzero(least == w)
            ok[at] = np.bitwise_count(values[place[i[at]]] ^ values[place[j[at]]]).sum(1, dtype=np.int64) <= most[at]
        got_a.append(i[ok])
        got_b.append(j[ok])
        row = stop
    i, j = np.concatenate([np.zeros(0, np.int64), *got_a]), np.concatenate([np.zeros(0, np.int64), *got_b])
    a, b = np.minimum(name[i], name[j]), np.maximum(name[i], name[j])
    if len(a):
        once = np.unique(a * np.int64(len(node)) + b)
        a, b = once // len(node), once % len(node)
        if not all_pairs:
            at = spanning(a, b)
            a, b = a[at], b[at]
    return pa.table({"a": pa.array(node[a], pa.int64()), "b": pa.array(node[b], pa.int64())})


ENTRY = ("token", "rid", "n", "sk", "comp")


def _searched(entries: DataFrame, threshold: Threshold, all_pairs: bool) -> DataFrame:
    """(a, b) from rows of ``entries`` that have one (bin, i, j)."""
    return entries.groupBy("bin", "i", "j").applyInArrow(lambda t: passing(t, threshold, all_pairs), "a long, b long").distinct()


def _cold(entries: DataFrame, bins: int) -> DataFrame:
    return entries.where(f"sets <= {BLOCK}").select(F.pmod(F.xxhash64("token"), F.lit(bins)).alias("bin"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), *ENTRY, F.lit(0).alias("side"))


def _within(entries: DataFrame, bins: int, threshold: Threshold) -> DataFrame:
    """Forests of the pairs that pass inside each shingle's blocks."""
    own = F.pmod(F.xxhash64("rid"), F.ceil(F.col("sets") / BLOCK)).cast("int")
    hot = entries.where(f"sets > {BLOCK}").select(F.col("token").alias("bin"), own.alias("i"), F.lit(0).alias("j"), *ENTRY, F.lit(0).alias("side"))
    return _searched(_cold(entries, bins).union(hot), threshold, False)


def _across(entries: DataFrame, bins: int, threshold: Threshold) -> DataFrame:
    """All pairs that pass between different components of a shingle."""
    hot = entries.where(f"sets > {BLOCK}")
    of = hot.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("of"))
    main = of.groupBy("token").agg(F.max(F.struct("of", "comp")).alias("main"), F.sum("of").alias("all"))
    main = main.select("token", F.col("main.comp").alias("main"), F.ceil(F.col("main.of") / BLOCK).cast("int").alias("nm"), F.ceil((F.col("all") - F.col("main.of")) / BLOCK).cast("int").alias("nr"))
    hot = hot.join(main, "token")
    part = F.xxhash64("rid")
    large = hot.where("comp = main").select(F.col("token").alias("bin"), F.pmod(part, F.col("nm")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nr") - 1)).alias("j"), *ENTRY, F.lit(0).alias("side"))
    rest = hot.where("comp <> main")
    facing = rest.select(F.col("token").alias("bin"), F.explode(F.sequence(F.lit(0), F.col("nm") - 1)).alias("i"), F.pmod(part, F.col("nr")).cast("int").alias("j"), *ENTRY, F.lit(1).alias("side"))
    own = rest.withColumn("own", F.pmod(part, F.col("nr")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nr") - 1)))
    among = own.select(F.col("token").alias("bin"), (-2 - F.least("own", "other")).alias("i"), F.greatest("own", "other").alias("j"), *ENTRY, F.col("own").alias("side"))
    return _searched(_cold(entries, bins).union(large).union(facing).union(among), threshold, True)


def _enough_matches(pairs: DataFrame, about: DataFrame) -> DataFrame:
    """Pairs whose prefixes share as many shingles as the smaller of their two numbers of matches (one, unless both say more)."""
    one, two = (about.where("l > 1").select(F.col("rid").alias(x), F.col("l").alias(f"l{x}"), F.col("prefix").alias(f"p{x}")) for x in ("a", "b"))
    need = F.least(F.coalesce("la", F.lit(1)), F.coalesce("lb", F.lit(1)))
    return pairs.join(one, "a", "left").join(two, "b", "left").where((need == 1) | (F.size(F.array_intersect("pa", "pb")) >= need)).select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, threshold: Threshold) -> DataFrame:
    """``pairs`` (a, b), a table that was cut, with ``ok``: whether the sets of the two texts (rid, size, text) reach the threshold."""
    bins = max(1, -(-pairs.count() // TASK_SETS))
    # a table of its own: while it is small, Spark sends it to the texts, and only those asked for are shuffled
    named = cut(pairs.select(F.col("a").alias("rid")).union(pairs.select("b")).distinct())
    texts = texts.join(named, "rid", "left_semi")
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / HUB).alias("parts"))
    dealt = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), "parts").alias("part"), "b")
    asked = dealt.select("a", "part", F.col("b").alias("rid")).union(dealt.select("a", "part", F.col("a").alias("rid")).distinct())

    def compare(t: pa.Table) -> pa.Table:
        a, part, rid = (t.column(c).to_numpy() for c in ("a", "part", "rid"))
        sets: list[np.ndarray] = []
        for batch in t.select(["size", "text"]).to_batches(max_chunksize=64):
            raw = [opened(x, size) for size, x in zip(batch.column("size").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            for _, data, offs in pieces(iter([pa.record_batch({"text": pa.array(raw, pa.binary())})])):
                sets += sets_of(data, offs, k)
        hub, got_a, got_b, ok = np.zeros(0, U64), [], [], []
        for i in np.lexsort((rid != a, part, a)).tolist():
            if rid[i] == a[i]:
                hub = sets[i]
            else:
                got_a.append(a[i])
                got_b.append(rid[i])
                ok.append(threshold.same(hub, sets[i]))
        return pa.table({"a": pa.array(got_a, pa.int64()), "b": pa.array(got_b, pa.int64()), "ok": pa.array(ok, pa.bool_())})

    return cut(asked.join(texts, "rid").groupBy(F.pmod(F.xxhash64("a", "part"), F.lit(bins)).alias("bin")).applyInArrow(compare, "a long, b long, ok boolean"))


FOUND = "rid long, doc_id {}, n long, k binary, l int, sk binary, prefix array<long>, tokens array<long>, size long, text binary"


def _bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one chunk as one compressed value: texts are shuffled so."""
    for part, _, _ in pieces(batches):
        chunk = part.column("_chunk").to_numpy()
        edge = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1]))
        sizes, rows = [], []
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(chunk)], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema) as writer:
                writer.write_batch(part.slice(a, b - a))
            raw = sink.getvalue()
            sizes.append(raw.size)
            rows.append(squeezed(raw))
        yield pa.record_batch({"_chunk": pa.array(chunk[edge]), "size": pa.array(sizes, pa.int64()), "rows": pa.array(rows, pa.binary())})


def _described(docs: DataFrame, k: int, threshold: Threshold) -> DataFrame:
    """One row for each document: its set's size and digest, and if its prefix may meet another's, what the search needs.

    Of equal sets in a chunk only the first row has the latter.
    """
    plan = Frequencies(docs.select("_chunk").distinct().count())
    levels = plan.levels(docs, lambda data, offs: sets_of(data, offs, k))

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        known, level = plan.looked_up(right)
        batches, seen = [], set()
        rows_of = pa.concat_tables([pa.ipc.open_stream(opened(raw, size)).read_all() for size, raw in zip(left.column("size").to_pylist(), left.column("rows").to_pylist(), strict=True)])
        for part, data, offs in pieces(iter(rows_of.sort_by("_rid").combine_chunks().to_batches())):
            found = sets_of(data, offs, k)
            flat = np.concatenate([np.zeros(0, U64), *found])
            lev, ends = levels_at(known, level, plan.short(flat)), np.cumsum([0, *map(len, found)])
            once = np.append(0, np.cumsum(lev == 0))
            keys, rows = [], []
            for i, u in enumerate(found):
                key = hashlib.blake2b(u.tobytes(), digest_size=16).digest() if len(u) else None
                keys.append(key)
                # most sets have so many shingles of their own that these fill the prefix
                if key and once[ends[i + 1]] - once[ends[i]] < threshold.prefix(len(u), 1) and key not in seen:
                    seen.add(key)
                    prefix, tokens, matches = ordered_prefix(u, lev[ends[i] : ends[i + 1]], threshold)
                    rows.append((matches, sketch(u, threshold.sketch_bits(len(u))), prefix.view(np.int64) if matches > 1 else None, tokens.view(np.int64), int(offs[i + 1] - offs[i]), squeezed(data[offs[i] : offs[i + 1]].tobytes())))
                else:
                    rows.append((None,) * 6)
            kinds = (pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary())
            batches.append(pa.record_batch(
                {"rid": part.column("_rid"), "doc_id": part.column("doc_id"), "n": pa.array([len(u) for u in found], pa.int64()), "k": pa.array(keys, pa.binary())}
                | {c: pa.array(x, t) for c, t, x in zip(("l", "sk", "prefix", "tokens", "size", "text"), kinds, zip(*rows, strict=True), strict=True)}
            ))
        release()
        return pa.Table.from_batches(batches)

    bundles = docs.select("_chunk", "_rid", "doc_id", "text").mapInArrow(_bundled, "_chunk long, size long, rows binary")
    return cut(bundles.groupBy("_chunk").cogroup(levels.withColumnRenamed("chunk", "_chunk").groupBy("_chunk")).applyInArrow(look, FOUND.format(dict(docs.dtypes)["doc_id"])))


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, numbered: bool = False) -> DataFrame:
    """(rid, doc_id, n_shingles, component_id, kept) for every row: components of the links with Jaccard >= num / den.

    ``docs`` has doc_id and text, and with ``numbered`` the _rid and _chunk of ``with_chunks``. component_id is the smallest doc_id of the
    component, and ``kept`` marks its first row by doc_id. A row without shingles is a component by itself.
    """
    small_batches(docs.sparkSession)
    return finished(docs.sparkSession, lambda: _near_duplicates(docs, k, Threshold(num, den), numbered))


def _near_duplicates(docs: DataFrame, k: int, threshold: Threshold, numbered: bool) -> DataFrame:
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), *(["_rid", "_chunk"] if numbered else []))
    found = _described(docs if numbered else with_chunks(docs), k, threshold)
    rows = found.select("rid", "doc_id", "n", "k")
    # the row number of each set, its smallest doc_id, and its first row by doc_id
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    nodes = cut(rows.where("k is not null").groupBy("k").agg(F.min("rid").alias("node"), F.min("doc_id").alias("least"), F.min(first).alias("first")))
    about = found.where("tokens is not null")
    pairs = cut(about.select("rid", "tokens").join(nodes.select(F.col("node").alias("rid")), "rid", "left_semi").select("rid", F.explode("tokens").alias("token")))
    met = cut(pairs.groupBy("token").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1"))
    entries = cut(pairs.join(met, "token").select("token", "rid", F.col("rid").alias("comp"), "sets"))
    texts, sketches = about.select("rid", "size", "text"), about.select("rid", "n", "sk")

    def checked(search: Callable[[DataFrame, int, Threshold], DataFrame], entries: DataFrame, known: DataFrame | None) -> DataFrame:
        bins = max(1, -(-entries.count() // BIN_ROWS))
        some = _enough_matches(search(entries.join(sketches, "rid"), bins, threshold), about)
        return _verified(cut(some if known is None else some.join(known.select("a", "b"), ["a", "b"], "left_anti")), texts, k, threshold)

    def split(of: DataFrame, roots: DataFrame) -> DataFrame:
        """Entries of shingles whose sets are in different components."""
        named = cut(of.join(roots.select(F.col("node").alias("rid"), "root"), "rid", "left").withColumn("comp", F.coalesce("root", "rid")).drop("root"))
        differ = cut(named.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("token"))
        return cut(named.join(differ, "token", "left_semi"))

    tried = checked(_within, entries, None)
    roots = components(tried.where("ok").select("a", "b"))
    left = split(entries, roots)
    if not left.where(f"sets > {BLOCK}").isEmpty():
        # blocks of one shingle know their own components only: one set for each of these meets the others'
        one = left.where(f"sets > {BLOCK}").groupBy("token", "comp").agg(F.min("rid").alias("rid"))
        some = cut(one.join(one.groupBy("token").agg(F.count(F.lit(1)).alias("sets")), "token"))
        tried = tried.union(checked(_within, some, tried))
        roots = components(tried.where("ok").select("a", "b"))
        left = split(left, roots)
    again = checked(_across, left, tried)
    if not again.where("ok").isEmpty():
        roots = components(tried.union(again).where("ok").select("a", "b"))
    named = nodes.join(roots, "node", "left").select("k", "least", "first", F.coalesce("root", "node").alias("comp"))
    of = named.groupBy("comp").agg(F.min("least").alias("component_id"), F.min("first").alias("keep"))
    by_key = cut(named.join(of, "comp").select("k", "component_id", F.col("keep.rid").alias("kept_rid")))
    return rows.join(by_key, "k", "left").select(
        "rid", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("k").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), (F.col("k").isNull() | (F.col("rid") == F.col("kept_rid"))).alias("kept")
    )


def op6_adaptive_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT rid, g FROM (SELECT rid, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(len(w) - 2), lambda i: array_to_string(w[i + 1 : i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d)
), sizes AS (
  SELECT rid, count(*) AS n FROM s GROUP BY rid
), common AS (
  SELECT x.rid AS a, y.rid AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.rid < y.rid GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes p ON p.rid = a JOIN sizes q ON q.rid = b WHERE 100 * c >= 90 * (p.n + q.n - c)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT rid AS node, rid AS other FROM d UNION SELECT node, b FROM reach JOIN both_ways ON other = a
)
SELECT d.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
FROM d JOIN reach ON d.rid = node JOIN d o ON o.rid = other LEFT JOIN sizes ON sizes.rid = d.rid GROUP BY d.rid, d.doc_id
"""
