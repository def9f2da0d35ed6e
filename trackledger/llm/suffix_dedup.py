"""Suffix-array dedup (10): bytes covered by a string of ``length`` bytes that starts anywhere else too.

1. *Routing.* Every window of ``length`` bytes belongs to the gram (16 bytes) of least hash in it, which lies in its
   first or in its second half. Neighbouring windows with one such gram in one half are a run; what they all hold (the
   gram and half a window beside it) is the run's core. Equal windows have equal cores, so only runs whose core occurs
   again can hold repeats: a twice-seen filter drops most others before anything is shuffled, and an exact count the
   rest. The gram alone would occur again by chance, in prose the more often the more text there is.
   Equal runs (128 bits) are counted, and one of each kind is kept.
2. *Shards.* Runs of different kinds with one core go, with their bytes, to the core's shard, unless each of these kinds
   occurs twice as a whole and so is repeats throughout. A shard is sorted by
   Larsson-Sadakane refinement in numpy (8 bytes first, then doubling, unsorted groups only, up to ``length``), and
   Kasai's scan, over all runs of the shard side by side, gives common prefixes with the suffix before. Neighbours that
   share ``length`` bytes are repeats.
3. *Merging.* A core with more than ``SHARD_RUNS`` kinds is dealt over several shards. Each of them passes on one sorted
   list of its distinct windows (128 bits); lists meet by hash range and are merged by binary search.
4. Repeats go back to all runs of their kind and, merged to spans, to their documents.

Defined results: null text is empty; texts shorter than ``length`` keep all bytes; equal texts of at least ``length``
bytes lose everything; repeated rows are separate documents; an empty table gives no rows. Where a cut falls inside a character, the kept text shows a replacement character; the
kept bytes are exact. Columns named like a result (n_bytes, n_removed, n_spans, kept) are replaced; other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackledger.llm.common import U64, bloom_has, cut, partitions, pieces, small_batches, span_hashes, table, with_row_id
from trackledger.llm.twice import filter_size, twice_filter

#: Kinds of runs in a shard, and shards that one task is meant to sort.
SHARD_RUNS, TASK_SHARDS = 2_000, 4
GRAM = 16
#: Bytes that are looked at together: few enough for their hashes to stay in a core's cache.
BLOCK = 1 << 18


def _grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` bytes from every position (the last ones are not whole and 0); it only orders them."""
    n = len(data)
    out = np.zeros(n, U64)
    if n >= GRAM:
        raw = np.ascontiguousarray(data)
        word = np.ndarray(n - 7, "<u8", raw, strides=(1,))
        late = word[8 : n - GRAM + 9] * U64(0xD6E8FEB86659FD93)
        late ^= late >> U64(29)
        x = np.multiply(word[: n - GRAM + 1], U64(0x9E3779B97F4A7C15), out=out[: n - GRAM + 1])
        x ^= late
        x ^= x >> U64(32)
        x *= U64(0xBF58476D1CE4E5B9)
    return out


def window_runs(data: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ``length``-byte windows of all documents, in runs whose windows have one least gram at one place, in the same half of each.

    Returns first window, windows and core hash of every run. Of equal least grams in a window the first counts, so equal
    windows lie at the same distance from equal grams, and two windows of one run are never equal. The core is what any window
    with that gram in that half holds, wherever its run begins and ends: the gram, and what is left of a window whose gram lies at the half's far end.
    """
    parts = []
    for a in range(0, max(1, len(data) - length + 1), BLOCK):
        part = data[a : a + BLOCK + length - 1]
        at, count, v = _runs(part, np.clip(offs - a, -1, len(part) + 1), length)
        parts.append((at + a, count, v))
    return tuple(map(np.concatenate, zip(*parts, strict=True)))  # type: ignore[return-value]


def _runs(data: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, width = len(data), length - GRAM + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    grams, low = _grams(data), U64(2 * BLOCK - 1)
    least, have = (grams & ~low) | np.arange(n, dtype=U64), 1  # the place breaks ties
    while have * 2 <= width:
        least = np.minimum(least[: len(least) - have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    least = (least[: n - length + 1] & low).astype(np.int64)
    # windows begin and end within a document; -1 and n + 1 are the bounds of what began before or ends beyond this block
    first, last = np.maximum(offs[:-1], 0), np.minimum(offs[1:], n)
    fits = last - first >= length
    room = np.zeros(n + 1, np.int64)
    np.add.at(room, first[fits], 1)
    np.add.at(room, last[fits] - length + 1, -1)
    inside = np.cumsum(room)[: len(least)] > 0
    edge = np.append(True, (least[1:] != least[:-1]) | (inside[1:] != inside[:-1]))
    edge[first[fits]] = True
    # a run is cut where its gram passes from the windows' second half into the first
    half, at = (width + 1) // 2, np.flatnonzero(edge)
    turn = least[at] - half + 1
    edge[turn[(turn > at) & (turn < np.append(at[1:], len(least)))]] = True
    at = np.flatnonzero(edge)
    count = np.diff(np.append(at, len(least)))
    keep = inside[at]
    at, count = at[keep], count[keep]
    place = least[at]
    early = place - at < half
    core = np.where(early, place, place - half), np.where(early, place - half + 1 + length, place + GRAM)
    return at, count, span_hashes(data, *core, False, 3)


def repeats_the_last(data: np.ndarray, at: np.ndarray, count: np.ndarray, v: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """Which runs follow the one before without a gap and have just its bytes, as in a text of one byte: these need no row of their own.

    Bytes are held against those one run later, for each number of windows that runs of a large share of the text have in common.
    """
    same = np.zeros(len(at), bool)
    if len(at) < 2:
        return same
    next_to = (doc[1:] == doc[:-1]) & (v[1:] == v[:-1]) & (count[1:] == count[:-1]) & (at[1:] == at[:-1] + count[:-1])
    sizes, many = np.unique(count[1:][next_to], return_counts=True)
    for c in sizes[many * (sizes + length) * 4 > len(data)].tolist():
        pair = np.flatnonzero(next_to & (count[1:] == c))
        differ = np.append(0, np.cumsum(data[:-c] != data[c:]))
        same[pair + 1] = differ[at[pair] + c + length - 1] == differ[at[pair]]
    return same


def suffix_sort(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """Window starts of all runs in the order of their ``length`` bytes (Larsson-Sadakane, by doubling).

    Runs lie in ``data`` from ``starts`` with ``sizes`` bytes. A position is refined to h bytes only while its run goes on for h.
    """
    left = np.repeat(starts + sizes, sizes) - np.arange(len(data))  # bytes to the run's end
    h = 8
    live = np.flatnonzero(left >= h)
    key = np.ndarray(max(0, len(data) - 7), ">u8", np.ascontiguousarray(data), strides=(1,))[live].astype(U64)
    order = np.argsort(key)
    key, pos = key[order], live[order]
    head = np.append(True, key[1:] != key[:-1])[: len(key)]
    slot = np.arange(len(pos))
    rank = np.zeros(len(data), np.int64)
    rank[pos] = np.maximum.accumulate(np.where(head, slot, 0))
    steps = []
    while h * 2 <= length:
        steps.append((h, h * 2))
        h *= 2
    if h < length:
        steps.append((length - h, length))
    for shift, reach in steps:
        # groups of one stand; the others are sorted by the rank further on
        alone = head & np.append(head[1:], True)[: len(head)]
        keep = ~alone
        pos, slot = pos[keep], slot[keep]
        keep = left[pos] >= reach
        pos, slot = pos[keep], slot[keep]
        if not len(pos):
            break
        own, on = rank[pos], rank[pos + shift]
        pack = own * (len(data) + 1) + on
        by = np.argsort(pack)
        pos, pack, own = pos[by], pack[by], own[by]
        head = np.append(True, pack[1:] != pack[:-1])
        first = np.append(True, own[1:] != own[:-1])
        # a group keeps its first slot; its members' new ranks count on from there
        at = np.arange(len(pos))
        inside = at - np.maximum.accumulate(np.where(first, at, 0))
        rank[pos] = own + np.maximum.accumulate(np.where(head, at, 0)) - (at - inside)
        slot = own + inside
    windows = np.flatnonzero(left >= length)
    return windows[np.argsort(rank[windows], kind="stable")]


def kasai(data: np.ndarray, starts: np.ndarray, counts: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place in ``order`` the bytes shared with the place before, up to ``length``.

    Kasai's scan goes through the text and loses at most one byte of prefix a step; here it goes through all runs at once.
    What a step leaves is a bound for the next only if the order told the two apart and the other run's next window is in it.
    """
    before = np.full(len(data), -1, np.int64)
    before[order[1:]] = order[:-1]
    shared = np.zeros(len(data), np.int64)
    padded = np.append(data, np.zeros(8, np.uint8))
    eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    listed = np.zeros(len(data) + 1, bool)
    listed[order] = True
    h = np.zeros(len(starts), np.int64)
    by_count = np.argsort(-counts, kind="stable")
    for t in range(int(counts.max(initial=0))):
        runs = by_count[: np.searchsorted(-counts[by_count], -t, "left")]
        i = starts[runs] + t
        j = before[i]
        got = np.where(j >= 0, np.maximum(h[runs] - 1, 0), 0)
        go = np.flatnonzero(j >= 0)
        while len(go):
            same = eight[i[go] + got[go]] == eight[j[go] + got[go]]
            got[go[same]] += 8
            single = go[~same]
            while len(single):
                eq = padded[i[single] + got[single]] == padded[j[single] + got[single]]
                single = single[eq]
                got[single] += 1
            go = go[same]
            go = go[got[go] < length]
        got = np.minimum(got, length)
        shared[i] = got
        h[runs] = np.where((got < length) & (j >= 0) & listed[j + 1], got, 0)
    return shared[order]


def _shard(length: int):
    """The work on one shard: rows (v, s, hot, bytes) -> covered windows, and for hot cores the shard's distinct windows."""

    def work(key: tuple, t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by([("v", "ascending"), ("s", "ascending")])
        raw = t.column("bytes").to_pylist()
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        starts = np.cumsum(sizes) - sizes
        counts = sizes - length + 1
        data = np.frombuffer(b"".join(raw), np.uint8)
        order = suffix_sort(data, starts, sizes, length)
        same = kasai(data, starts, counts, order, length) >= length
        repeat = np.zeros(len(data) + 1, bool)
        repeat[order[same]] = True
        repeat[order[np.flatnonzero(same) - 1]] = True
        run = np.searchsorted(starts, np.arange(len(data)), "right") - 1
        v, s, hot = (t.column(c).to_numpy() for c in ("v", "s", "hot"))
        out = [_spans(repeat[: len(data)], run, starts, v, s)]
        if hot.any():
            lead = order[~same]  # one of each distinct window
            lead = lead[hot[run[lead]]]
            d1, d2 = (span_hashes(data, lead, lead + length, False, seed).view(np.int64) for seed in (7, 99))
            by = np.lexsort((d2, d1))
            lead, d1, d2 = lead[by], d1[by], d2[by]
            first = lead - starts[run[lead]]
            out.append(pa.table({"v": v[run[lead]], "s": s[run[lead]], "t0": first, "t1": first + 1, "d1": d1, "d2": d2, "shard": np.full(len(lead), key[0].as_py(), np.int64)}))
        return pa.concat_tables(out, promote_options="default").select(["v", "s", "t0", "t1", "d1", "d2", "shard"])

    return work


COVER = "v long, s long, t0 long, t1 long, d1 long, d2 long, shard long"


def _spans(repeat: np.ndarray, run: np.ndarray, starts: np.ndarray, v: np.ndarray, s: np.ndarray) -> pa.Table:
    edge_run = run[1:] != run[:-1]
    first = np.flatnonzero(repeat & np.append(True, ~repeat[:-1] | edge_run)[: len(repeat)])
    last = np.flatnonzero(repeat & np.append(~repeat[1:] | edge_run, True)[: len(repeat)])
    own = run[first]
    none = pa.nulls(len(first), pa.int64())
    return pa.table({"v": v[own], "s": s[own], "t0": first - starts[own], "t1": last + 1 - starts[own], "d1": none, "d2": none, "shard": none})


def _merge(key: tuple, t: pa.Table) -> pa.Table:
    """Sorted lists of window digests, one from each shard: members of two lists are repeats."""
    t = t.combine_chunks().sort_by([("shard", "ascending"), ("d1", "ascending"), ("d2", "ascending")])
    shard, d1, d2 = (t.column(c).to_numpy() for c in ("shard", "d1", "d2"))
    digest = np.empty(len(d1), [("a", np.int64), ("b", np.int64)])
    digest["a"], digest["b"] = d1, d2
    hit = np.zeros(len(d1), bool)
    known, where = digest[:0], np.zeros(0, np.int64)
    bounds = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
    for a, b in zip(bounds.tolist(), [*bounds[1:].tolist(), len(d1)], strict=True):
        at = np.searchsorted(known, digest[a:b])
        there = np.flatnonzero(at < len(known))
        there = there[known[at[there]] == digest[a:b][there]]
        hit[a + there] = True
        hit[where[at[there]]] = True
        new = np.delete(np.arange(b - a), there)
        known, where = np.insert(known, at[new], digest[a:b][new]), np.insert(where, at[new], a + new)
    return t.filter(pa.array(hit)).select(["v", "s", "t0", "t1"])


def remove_repeats(docs: DataFrame, length: int = 200, filter_bits: int | None = None, shard_runs: int = SHARD_RUNS) -> DataFrame:
    """The columns of ``docs`` (text without its repeated bytes) with n_bytes, n_removed, n_spans and ``kept`` (the bytes left)."""
    if length < 2 * GRAM:
        raise ValueError(f"length is {2 * GRAM} or more")
    small_batches(docs.sparkSession)
    others = [c for c in docs.columns if c not in ("text", "n_bytes", "n_removed", "n_spans", "kept", "_rid", "_runs", "_spans")]
    docs = with_row_id(docs.select(*others, F.col("text").cast("string").alias("text")))
    texts = docs.select("_rid", "text")
    shared = docs.sparkSession.sparkContext.broadcast(twice_filter(docs, lambda data, offs: window_runs(data, offs, length)[2], filter_bits or filter_size(docs, 0.125)))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in pieces(batches):
            at, count, v = window_runs(data, offs, length)
            keep = bloom_has(shared.value, v)
            at, count, v = at[keep], count[keep], v[keep]
            doc = np.searchsorted(offs, at, "right") - 1
            first = np.flatnonzero(~repeats_the_last(data, at, count, v, doc, length))
            times = np.diff(np.append(first, len(at)))
            at, count, v, doc = at[first], count[first], v[first], doc[first]
            yield pa.record_batch({
                "v": pa.array(v.view(np.int64)), "s": pa.array(span_hashes(data, at, at + count + length - 1, False).view(np.int64)),
                "rid": pa.array(part.column("_rid").to_numpy()[doc]), "at": pa.array(at - offs[doc], pa.int64()), "n": pa.array(count, pa.int32()), "times": pa.array(times, pa.int64()),
            })

    found = cut(texts.mapInArrow(runs, "v long, s long, rid long, at long, n int, times long"))
    # any one of equal runs will do; first() of one row's columns is hashed, the least struct would be sorted
    kinds = found.groupBy("v", "s").agg(F.sum("times").alias("copies"), *(F.first(x).alias(x) for x in ("rid", "at", "n")))
    cores = kinds.groupBy("v").agg(F.sum("copies").alias("all"), F.count(F.lit(1)).alias("kinds"), F.count_if(F.col("copies") == 1).alias("single")).where(F.col("all") > 1)
    kinds = cut(kinds.join(cores, "v").select("v", "s", "copies", "kinds", "single", "rid", "at", "n"))
    many = kinds.where("kinds > 1 and single > 0")
    shards = max(1, -(-many.count() // shard_runs))
    hot = F.col("kinds") > shard_runs
    salt = F.when(hot, F.pmod(F.xxhash64("s"), F.ceil(F.col("kinds") / shard_runs))).otherwise(0)
    listed = many.groupBy("rid").agg(F.collect_list(F.struct("v", "s", hot.alias("hot"), F.pmod(F.xxhash64("v", salt), F.lit(shards)).alias("shard"), "at", "n")).alias("_runs"))
    item = "v long, s long, hot boolean, shard long, bytes binary"

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in pieces(batches):
            lists = part.column("_runs")
            flat = lists.flatten()
            doc = np.repeat(np.arange(part.num_rows), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
            a = offs[doc] + flat.field("at").to_numpy(zero_copy_only=False)
            b = a + flat.field("n").to_numpy(zero_copy_only=False) + length - 1
            raw = data.tobytes()
            yield pa.record_batch({c: flat.field(c) for c in ("v", "s", "hot", "shard")} | {"bytes": pa.array([raw[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.binary())})

    # the work is in the sort, not in the bytes: a task gets few shards, where Spark would go by megabytes
    sent = texts.join(listed.hint("shuffle_hash"), F.col("_rid") == F.col("rid")).select("text", "_runs").mapInArrow(take, item).repartition(partitions(docs, -(-shards // TASK_SHARDS)), "shard")
    cover = cut(sent.groupBy("shard").applyInArrow(_shard(length), COVER))
    merged = cover.where("d1 is not null").groupBy(F.pmod("d1", F.lit(shards)).alias("range")).applyInArrow(_merge, "v long, s long, t0 long, t1 long")
    whole = kinds.where("copies > 1").select("v", "s", F.lit(0).cast("long").alias("t0"), F.col("n").cast("long").alias("t1"))
    part = cover.where("d1 is null").select("v", "s", "t0", "t1").union(merged).join(kinds.where("copies = 1").select("v", "s"), ["v", "s"])
    # a run told with its repeats has copies, so all its windows are covered, and so is what lies between
    back = found.join(whole.union(part), ["v", "s"]).groupBy("rid").agg(F.collect_list(F.struct((F.col("at") + F.col("t0")).alias("start"), (F.col("at") + (F.col("times") - 1) * F.col("n") + F.col("t1") + (length - 1)).alias("end"))).alias("_spans"))
    joined = docs.join(back.hint("shuffle_hash"), F.col("_rid") == F.col("rid"), "left").select(*others, "text", "_spans")
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.select(*others).dtypes) + (", " if others else "") + "text string, n_bytes long, n_removed long, n_spans long, kept binary"

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in pieces(batches):
            yield _removed(part, data, offs, others)

    return joined.mapInArrow(remove, schema)


def _removed(part: pa.RecordBatch, data: np.ndarray, offs: np.ndarray, others: list[str]) -> pa.RecordBatch:
    n, lists = part.num_rows, part.column("_spans")
    flat = lists.flatten()
    size = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(n), size)
    edge = np.zeros(len(data) + 1, np.int64)
    np.add.at(edge, offs[doc] + flat.field("start").to_numpy(zero_copy_only=False).astype(np.int64), 1)
    np.add.at(edge, offs[doc] + flat.field("end").to_numpy(zero_copy_only=False).astype(np.int64), -1)
    gone = np.cumsum(edge)[:-1] > 0
    owner = np.repeat(np.arange(n), np.diff(offs))
    begins = gone & np.append(True, ~gone[:-1] | (owner[1:] != owner[:-1]))[: len(gone)]
    removed, spans = np.bincount(owner[gone], minlength=n), np.bincount(owner[begins], minlength=n)
    kept, raw = [], data.tobytes()
    for i in range(n):
        a, b = offs[i], offs[i + 1]
        kept.append(data[a:b][~gone[a:b]].tobytes() if removed[i] else raw[a:b])
    return pa.record_batch({c: part.column(c) for c in others} | {
        "text": pa.array([x.decode("utf-8", "replace") for x in kept], pa.string()), "n_bytes": pa.array(np.diff(offs), pa.int64()), "n_removed": pa.array(removed, pa.int64()),
        "n_spans": pa.array(spans, pa.int64()), "kept": pa.array(kept, pa.binary()),
    })


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=200)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, encode(coalesce(text, '')) AS h FROM documents
), windows AS (
  SELECT rid, p, md5(array_slice(h, p + 1, p + 200)) AS k FROM (SELECT rid, h, unnest(range(octet_length(h) - 199)) AS p FROM d WHERE octet_length(h) >= 200)
), repeats AS (
  SELECT k FROM windows GROUP BY k HAVING count(*) > 1
), hits AS (
  SELECT rid, p FROM windows SEMI JOIN repeats USING (k)
), bytes AS (
  SELECT rid, q, hex(array_slice(h, q + 1, q + 1)) AS b FROM (SELECT rid, h, unnest(range(octet_length(h))) AS q FROM d)
), marked AS (
  SELECT rid, q, b, coalesce(max(p) OVER (PARTITION BY rid ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) > q - 200, false) AS gone
  FROM (SELECT bytes.rid, q, b, p FROM bytes LEFT JOIN hits ON bytes.rid = hits.rid AND q = p)
), edges AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY rid ORDER BY q), false) AS begins FROM marked
), done AS (
  SELECT rid, count(*) AS n, count(*) FILTER (WHERE gone) AS r, count(*) FILTER (WHERE begins) AS s, string_agg(b, '' ORDER BY q) FILTER (WHERE NOT gone) AS kept FROM edges GROUP BY rid
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_bytes, CAST(coalesce(r, 0) AS BIGINT) AS n_removed, CAST(coalesce(s, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN done USING (rid)
"""
