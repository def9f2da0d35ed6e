"""Line dedup, decontamination, Jaccard join, suffix dedup: brute force on small fixtures with nulls, ties, long and empty texts."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest

from trackledger.llm import jaccard, suffix_dedup
from trackledger.llm.common import shingles, span_hashes, text_buffer, with_chunks, with_row_id
from trackledger.llm.components import components
from trackledger.llm.decontaminate import FMIndex, find_benchmark, suffix_order
from trackledger.llm.frequency import Frequencies, level_of, packed, unpacked
from trackledger.llm.jaccard import near_duplicates, sets_of, spanning
from trackledger.llm.line_dedup import drop_lines
from trackledger.llm.packing import pack, ranks_path
from trackledger.llm.sharding import shard_documents
from trackledger.llm.suffix_dedup import kasai, remove_repeats, suffix_sort, window_runs

EXTRA = "doc_id long, text string, n_lines string, spans string, score string, _rid string"
WORDS = "the of and Straße naïve x1 über fox dog cat runs far away now then some more words here today".split()


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def table(spark, tmp_path, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    df = spark.createDataFrame([(i, t, "own", "own", "own", "own") for i, t in zip(ids, texts, strict=True)], EXTRA)
    df.write.parquet(str(tmp_path / "docs"))
    return spark.read.parquet(str(tmp_path / "docs"))


def corpus(seed, n=120):
    rnd = random.Random(seed)
    base = [" ".join(rnd.choices(WORDS, k=rnd.choice([1, 2, 3, 12, 60, 200]))) for _ in range(n // 4)]
    out = [None, "", " ", "\n", "\n\n", "A", "a\t", "x" * 500, "ab" * 300, "é" * 300]
    for _ in range(n):
        t = rnd.choice(base)
        kind = rnd.random()
        if kind < 0.3:
            w = t.split(" ")
            w[rnd.randrange(len(w))] = rnd.choice(WORDS)
            t = " ".join(w)
        elif kind < 0.5:
            t = t + "\n" + rnd.choice(base) + " \n" + t.upper()
        elif kind < 0.6:
            t = " ".join(rnd.choices(WORDS, k=50))
        out.append(t)
    return out


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("bits", [64, 1 << 16])
def test_lines(spark, tmp_path, keep, bits):
    texts = corpus(1)
    docs = table(spark, tmp_path, texts)
    got = {r["doc_id"]: r for r in drop_lines(docs, 3, 1, keep, bits).collect()}
    key = lambda x: lower(re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x))
    lines = {i: (t or "").split("\n") for i, t in enumerate(texts)}
    seen = collections.Counter(k for ls in lines.values() for k in {key(x) for x in ls} if k)
    assert len(got) == len(texts)
    first = {k: min(r["doc_id"] for r in with_row_id(docs).collect() if k in map(key, lines[r["doc_id"]])) for k in seen} if keep == "first" else {}
    order = {r["doc_id"]: r["_rid"] for r in with_row_id(docs).select("doc_id", "_rid").collect()}
    if keep == "first":
        first = {k: min((d for d in lines if k in map(key, lines[d])), key=order.get) for k in seen}
    for i, ls in lines.items():
        kept, done = [], set()
        for x in ls:
            k = key(x)
            if k and seen[k] >= 3 and not (first.get(k) == i and k not in done):
                continue
            done.add(k)
            kept.append(x)
        assert (got[i]["n_lines"], got[i]["n_dropped"], got[i]["text"]) == (len(ls), len(ls) - len(kept), "\n".join(kept))


def windows_of(items, n):
    out = collections.defaultdict(set)
    for i, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        for k in range(max(1, len(w) - n + 1) if w else 0):
            out[tuple(w[k : k + n])].add(str(i))
    return out


@pytest.mark.parametrize("block", [64 << 20, 200])
def test_benchmark(spark, tmp_path, block):
    texts = corpus(2)
    items = [(i, t) for i, t in enumerate(texts[10:30])] + [(100, None), (101, ""), (102, "the of"), (103, texts[12]), (103, texts[12])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = table(spark, tmp_path, texts)
    got = {r["doc_id"]: r for r in find_benchmark(docs, bench, 6, block).collect()}
    win = windows_of(items, 6)
    for i, t in enumerate(texts):
        w, hit, ids = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)), set(), set()
        for n in {len(x) for x in win}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in win:
                    hit |= set(range(k, k + n))
                    ids |= win[tuple(w[k : k + n])]
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["item_ids"]) == (len(w), len(hit), sorted(ids)), t
    clean = {r["doc_id"]: r for r in find_benchmark(docs, bench, 6, remove=True).collect()}
    assert all((clean[i]["text"] == t) == (not got[i]["n_hit"]) for i, t in enumerate(texts))
    assert find_benchmark(docs, bench.limit(0), 6).where("n_hit > 0").count() == 0


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(3)
    text = np.concatenate([rng.integers(2, 5, 300), [1], rng.integers(2, 5, 80), [0]])
    assert suffix_order(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
    index = FMIndex(text, 4)
    for n in (1, 3, 5):
        phrases = rng.integers(2, 5, (30, n))
        lo, hi = index.search(phrases, np.full(30, n))
        for p, a, b in zip(phrases, lo, hi, strict=True):
            there = [i for i in range(len(text) - n + 1) if text[i : i + n].tolist() == p.tolist()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == there


@pytest.mark.parametrize("k, num", [(3, 90), (5, 80), (2, 50)])
def test_jaccard(spark, tmp_path, k, num):
    texts = corpus(k, 160)
    check_jaccard(near_duplicates(table(spark, tmp_path, texts), k, num, 100), texts, k, num)


def check_jaccard(found, texts, k, num):
    got = found.toPandas().set_index("doc_id").sort_index()
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= num * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert (got.loc[i].component_id, got.loc[i].n_shingles) == (find(i), len(sets[i]))
        assert bool(got.loc[i].kept) == (find(i) == i)


def plain_removed(texts, length):
    """(bytes, removed, spans, kept) of every text, windows counted one by one."""
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(r), int(gone.sum()), spans, bytes(np.frombuffer(r, np.uint8)[~gone])))
    return out


def test_texts_that_repeat_themselves(spark, tmp_path):
    """Short periods, also broken and in several documents: their runs are told once, and the same bytes go."""
    texts = ["a" * 3000, "ab" * 900 + "c" + "ab" * 900, "a" * 199, "a" * 200, "abc" * 400 + "tail" * 30, "x" + "a" * 500 + "y", "".join(chr(97 + i % 23) for i in range(2000)), "q" * 250 + "z" * 250, None]
    got = {r["doc_id"]: r for r in remove_repeats(table(spark, tmp_path, texts)).collect()}
    for i, expected in enumerate(plain_removed(texts, 200)):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == expected, i


def test_a_long_text_of_one_byte_has_few_runs():
    data, offs = text_buffer(pa.array(["a" * 2_000_000]))
    at, count, v = window_runs(data, offs, 200)
    same = suffix_dedup.repeats_the_last(data, at, count, v, np.zeros(len(at), np.int64), 200)
    assert len(at) > 1_000_000 and (~same).sum() < 100


def test_ids_of_any_type(spark, tmp_path):
    texts = [" ".join(f"w{i}" for i in range(k, k + 40)) for k in (0, 0, 7, 300)] + [None]
    docs = spark.createDataFrame([(f"id-{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    near = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs).collect()}
    assert near == {"id-0": "id-0", "id-1": "id-0", "id-2": "id-2", "id-3": "id-3", "id-4": "id-4"}
    packed = pack(docs, ranks_path(), window=64).collect()
    assert {r["doc_id"] for r in packed} == set(near)
    assert {r["doc_id"] for r in shard_documents(docs, shards=3).collect()} == set(near)


def test_jaccard_of_repeated_and_null_ids(spark, tmp_path):
    got = near_duplicates(table(spark, tmp_path, ["a b c d", "a b c d", "a b c d", None, None], [5, 5, None, None, 9]), 3, 90, 100).collect()
    assert [r["component_id"] for r in sorted(got, key=lambda r: r["rid"]) if r["n_shingles"]] == [5, 5, 5]
    assert sum(r["kept"] for r in got if r["n_shingles"]) == 1 and all(r["kept"] and r["component_id"] == r["doc_id"] for r in got if not r["n_shingles"])


@pytest.mark.parametrize("shard_runs", [3, 2000])
def test_repeated_strings(spark, tmp_path, shard_runs):
    texts = corpus(4)
    length = 40
    got = {r["doc_id"]: r for r in remove_repeats(table(spark, tmp_path, texts), length, 1 << 16, shard_runs).collect()}
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[p : p + length] for b in raw for p in range(len(b) - length + 1))
    for i, b in enumerate(raw):
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for q in range(len(b)) if gone[q] and (q == 0 or not gone[q - 1]))
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"]) == (len(b), sum(gone), spans)
        assert hashlib.sha256(bytes(got[i]["kept"])).digest() == hashlib.sha256(kept).digest()


def test_suffixes_and_prefixes():
    rnd = random.Random(5)
    runs = [bytes(rnd.choices(b"ab", k=rnd.randrange(32, 90))) for _ in range(20)]
    data = np.frombuffer(b"".join(runs), np.uint8)
    sizes = np.array(list(map(len, runs)))
    starts = np.cumsum(sizes) - sizes
    order = suffix_sort(data, starts, sizes, 32)
    text = data.tobytes()
    assert [text[i : i + 32] for i in order] == sorted(text[s + t : s + t + 32] for s, n in zip(starts, sizes, strict=True) for t in range(n - 31))
    shared = kasai(data, starts, sizes - 31, order, 32)
    for p in range(1, len(order)):
        a, b = text[order[p - 1] : order[p - 1] + 32], text[order[p] : order[p] + 32]
        assert shared[p] == next((i for i in range(32) if a[i] != b[i]), 32)


def test_window_runs_cover_every_window_once():
    data, offs = text_buffer(pa.array(corpus(6), pa.string()))
    at, count, _ = window_runs(data, offs, 40)
    covered = np.concatenate([np.arange(a, a + n) for a, n in zip(at, count, strict=True)])
    wanted = [p for a, b in zip(offs[:-1], offs[1:], strict=True) for p in range(a, b - 39)]
    assert sorted(covered.tolist()) == wanted


def test_short_texts_are_one_shingle():
    h = np.array([1, 2, 3, 4, 5], np.uint64)
    sets = shingles(h, np.array([0, 0, 1, 1, 1]), 3, 3)
    assert [len(s) for s in sets] == [1, 1, 0]


def test_components_and_forests(spark):
    rnd = random.Random(7)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(150)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    a, b = np.array([0, 1, 2, 0, 4]), np.array([1, 2, 0, 2, 5])
    assert len(spanning(a, b)) == 3


def test_empty_tables(spark, tmp_path):
    docs = table(spark, tmp_path, ["x"]).limit(0)
    docs.write.parquet(str(tmp_path / "none"))
    docs = spark.read.parquet(str(tmp_path / "none"))
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert drop_lines(docs).count() == find_benchmark(docs, bench).count() == near_duplicates(docs).count() == remove_repeats(docs).count() == 0


def test_row_numbers_outlive_other_splits(spark, tmp_path):
    """The size of splits follows the cores of the moment: numbers must not change with it."""
    path = str(tmp_path / "rows")
    spark.range(400).repartition(8).write.parquet(path)
    numbered = with_row_id(spark.read.parquet(path))
    before = {r["id"]: r["_rid"] for r in numbered.collect()}
    usual = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
        assert {r["id"]: r["_rid"] for r in numbered.select("id", "_rid").where("id >= 0").collect()} == before
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", usual)


def thue_morse(n, a, b):
    """Two strings that collide under any sum of byte values times powers of an odd base modulo 2**64."""
    return ("".join((a, b)[i.bit_count() & 1] for i in range(n)), "".join((b, a)[i.bit_count() & 1] for i in range(n)))


@pytest.mark.parametrize("size", [1024, 4096, 8192])
def test_hashes_stand_patterned_strings(spark, tmp_path, size):
    x, y = thue_morse(size, "a", "b")
    data, offs = text_buffer(pa.array([x, y, x.upper(), y[:-1]], pa.string()))
    h = span_hashes(data, offs[:-1], offs[1:])
    assert h[0] == h[2] and len(set(h.tolist())) == 3 and len(set(span_hashes(data, offs[:-1], offs[1:], False).tolist())) == 4
    docs = table(spark, tmp_path, [x, y] * 6)
    assert {r["n_dropped"] for r in drop_lines(docs, min_docs=10).collect()} == {0}
    assert {r["n_dropped"] for r in drop_lines(docs, min_docs=6).collect()} == {1}
    assert {r["component_id"] for r in near_duplicates(docs).collect()} == {0, 1}
    found = find_benchmark(docs, spark.createDataFrame([(1, x)], "item_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in found if r["n_hit"]) == [0, 2, 4, 6, 8, 10]


@pytest.mark.parametrize("block", [2, 5])
def test_shingles_of_many_sets_are_cut_into_blocks(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rnd = random.Random(9)
    base = [rnd.choices(WORDS, k=40) for _ in range(3)]
    texts = []
    for _ in range(90):
        w = list(rnd.choice(base))
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(40)] = rnd.choice(WORDS)
        texts.append(" ".join(w))
    check_jaccard(near_duplicates(table(spark, tmp_path, texts), 2, 80, 100), texts, 2, 80)


def test_frequencies_reach_every_chunk(spark, tmp_path):
    texts = corpus(8, 60)
    docs = with_chunks(table(spark, tmp_path, texts).select("doc_id", "text").repartition(3), 2000)
    plan = Frequencies(50)
    plan.ranges = 5
    got = plan.levels(docs, lambda data, offs: sets_of(data, offs, 2)).toArrow()
    sets = {}
    for t in texts:
        data, offs = text_buffer(pa.array([t], pa.string()))
        sets[t] = sets_of(data, offs, 2)[0].tolist()
    seen = collections.Counter(int(h) >> int(plan.shift) for t in texts for h in sets[t])
    chunks = collections.defaultdict(set)
    for r in docs.collect():
        chunks[r["_chunk"]] |= {int(h) >> int(plan.shift) for h in sets[r["text"]]}
    assert len(chunks) > 2
    for c, held in chunks.items():
        known, level = plan.looked_up(got.filter(pa.compute.equal(got.column("chunk"), c)))
        assert known.tolist() == sorted(h for h in held if seen[h] > 1)
        assert level.tolist() == [int(level_of(np.array([seen[h]]))[0]) for h in known.tolist()]
    numbers = np.sort(np.random.default_rng(1).choice(1 << 39, 5000, replace=False).astype(np.uint64))
    assert (unpacked(packed(numbers, 5), 5000, 5) == numbers).all()


def test_sketches_fold():
    rng = np.random.default_rng(2)
    t = jaccard.Threshold(80, 100)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (5, 250, 300, 1500, 20_000)]
    raw = [jaccard.sketch(u, t.sketch_bits(len(u))) for u in sets]
    width = np.array([len(r) * 8 for r in raw])
    assert width.tolist() == sorted(width.tolist()) and len(set(width.tolist())) > 3
    for w, (place, values) in jaccard.folded(raw, width).items():
        for i, u in enumerate(sets):
            if width[i] >= w:
                assert values[place[i]].tobytes() == jaccard.sketch(u, w)


def test_items_without_an_id_are_hit_but_not_named(spark, tmp_path):
    docs = table(spark, tmp_path, ["a b c d e f", "x"])
    bench = spark.createDataFrame([(None, "b c d"), (7, "c d e"), (8, None)], "item_id long, text string")
    for block in (8 << 20, 3):
        got = {r["doc_id"]: r for r in find_benchmark(docs, bench, 3, block).collect()}
        assert (got[0]["n_hit"], got[0]["item_ids"], got[1]["n_hit"], got[1]["item_ids"]) == (4, ["7"], 0, [])


def test_long_texts_are_cut_into_blocks(monkeypatch):
    rnd = random.Random(4)
    data, offs = text_buffer(pa.array(["".join(rnd.choices("ab", k=n)) for n in (900, 10, 0, 3000, 256)], pa.string()))

    def windows():
        at, count, v = window_runs(data, offs, 40)
        return {int(p): int(h) for a, n, h in zip(at, count, v, strict=True) for p in range(a, a + n)}, int(count.sum())

    whole, n = windows()
    monkeypatch.setattr(suffix_dedup, "BLOCK", 256)
    assert windows() == (whole, n) and len(whole) == n == sum(max(0, int(s) - 39) for s in np.diff(offs))


def test_a_common_phrase_brings_no_runs_together():
    """Texts that share a few words, not a window, have no run in common; those that share a window have."""
    rnd = random.Random(6)
    phrase = "a phrase that many texts hold somewhere "
    texts = ["".join(rnd.choices("abcdefgh", k=400)) + phrase + "".join(rnd.choices("abcdefgh", k=400)) for _ in range(30)]
    seen = collections.Counter()
    for t in texts:
        seen.update(set(window_runs(*text_buffer(pa.array([t])), 200)[2].tolist()))
    assert max(seen.values()) == 1
    for t in texts:
        again = window_runs(*text_buffer(pa.array(["zz" + t[230:640] + "yy"])), 200)[2].tolist()
        assert len(set(again) & set(seen)) >= 3


def test_lines_and_words_beyond_the_usual(spark, tmp_path):
    long = "w" * 5000
    docs = table(spark, tmp_path, [f"{long}\n{long}x", f"{long.upper()} ", f"{long}y", " ".join([long] * 6), " ".join([long] * 6) + " z"])
    got = {r["doc_id"]: r["n_dropped"] for r in drop_lines(docs, min_docs=2).collect()}
    assert got == {0: 1, 1: 1, 2: 0, 3: 0, 4: 0}
    assert near_duplicates(docs, 2, 50, 100).where("component_id = 3").count() == 2
