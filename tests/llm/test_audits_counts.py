"""Source divergence, token counts and filter interactions: plain versions on small fixtures with nulls, ties, long and empty texts."""

from __future__ import annotations

import collections
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import public_tokenizers
from tokenizers import Tokenizer
from trackledger.llm import filter_audit, source_audit
from trackledger.llm.common import text_buffer
from trackledger.llm.token_counts import Counter, count_tokens, whole_tokens

BPE = public_tokenizers.path("byte_bpe_50k.json")
WORDS = "the of and Straße naïve ÜBER Über fox dog cat runs far away now then some more words here today Élan zebra İx ab12cd".split()


# ---------------------------------------------------------------- tokens
@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(BPE)


@pytest.fixture(scope="module")
def counter():
    with open(BPE, encoding="utf-8") as f:
        text = f.read()
    return Counter(text, whole_tokens(text))


PARTS = st.sampled_from(["<|endoftext|>", "<|endof", "text|>", "'s", " ", "\n", "\t", "　", "é", "漢字", "the", " tokens", "１²½", "!?", "😀", "xq" * 40, "\x00", "ll'", "<|"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=8).map("".join), max_size=6))
def test_counts_equal_the_library(tokenizer, counter, texts):
    """Special strings are found inside texts, but not across two of them."""
    data, offs = text_buffer(pa.array(texts, pa.string()))
    assert counter.count(data, offs).tolist() == [len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_whole_tokens_are_proven(tokenizer, counter):
    vocabulary = tokenizer.get_vocab(with_added_tokens=False)
    assert 50_000 < len(counter.whole) <= len(vocabulary)
    assert counter.added == {b"<|endoftext|>"} and b"<|endoftext|>" not in set(counter.whole.to_pylist())


def test_known_pieces_are_not_merged(counter):
    before = counter.merged
    data, offs = text_buffer(pa.array(["the people of the world were there"]))
    assert counter.count(data, offs).tolist() == [7] and counter.merged == before
    data, offs = text_buffer(pa.array(["qzxqzxq"]))
    counter.count(data, offs)
    counter.count(data, offs)
    assert counter.merged == before + 1  # remembered


def test_count_tokens(spark, tokenizer):
    texts = ["", None, "abc <|endoftext|> d", "the " * 600, "z" * 200_000, "the " * 600]
    rows = [(i, t, "own", 7) for i, t in enumerate(texts)] + [(None, "no id", "own", 7)]
    got = count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, extra int"), BPE).collect()
    assert len(got) == 7 and got[0].asDict().keys() == {"doc_id", "extra", "n_bytes", "n_tokens", "over_limit"}
    for r in got:
        text = "no id" if r["doc_id"] is None else texts[r["doc_id"]] or ""
        n = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 512)
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), BPE).count() == 0


def test_other_kinds_of_files_are_refused(spark):
    with pytest.raises(ValueError, match="byte-level"):
        count_tokens(spark.createDataFrame([], "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json"))


# ---------------------------------------------------------------- filters
def plain_steps(docs, labels):
    """Rows of all orders by applying the filters one after the other."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    first = {}
    for d, text, _ in docs:
        if d is not None:
            first[text or ""] = min(d, first.get(text or "", d))
    parts = collections.defaultdict(list)
    for d, text, source in docs:
        text = text or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": d is not None and d > first[text]}
        parts[source or ""].append((fails, d in good, d in toxic))
    out = set()
    for part, rows in parts.items():
        removed_by, made = collections.Counter(), []
        for order in map("".join, itertools.permutations("ABCDE")):
            left, gone = rows, []
            for k, f in enumerate(order):
                hit = [r for r in left if r[0][f]]
                left = [r for r in left if not r[0][f]]
                removed_by[f] += len(hit)
                made.append((f, order, k + 1, len(left), len(hit), sum(r[0][f] for r in gone), sum(r[0][f] and sum(r[0].values()) == 1 for r in rows), sum(r[1] for r in hit), sum(r[2] for r in hit)))
                gone = gone + hit
        out |= {(part, *m[1:], removed_by[m[0]]) for m in made}
    return out


@pytest.mark.parametrize("seed", range(2))
def test_filter_interactions_equal_applying_them(spark, seed):
    rnd = random.Random(seed)
    texts = [None, "", " ", "short", "A" * 300, "x" * 250 + " #", " ".join(f"w{i}" for i in range(250)), "\x0b".join(["same"] * 400), "é É " * 10, "$ " + " ".join(f"w{i}" for i in range(300))]
    docs = [(rnd.choice([None, *range(25)]), rnd.choice(texts), rnd.choice([None, "", "a", "b"])) for _ in range(80)]
    labels = [(rnd.choice([None, *range(25)]), rnd.choice([0, 1, None]), rnd.choice([0, 1])) for _ in range(40)]
    df = spark.createDataFrame([(*d, 1, "own") for d in docs], "doc_id long, text string, source string, n long, good string")
    got = filter_audit.filter_interactions(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {tuple(r) for r in got} == plain_steps(docs, labels) and len(got) == 3 * 600


def test_no_documents_no_steps(spark):
    assert filter_audit.filter_interactions(spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


# ---------------------------------------------------------------- sources
def plain_audit(docs, min_docs, ranks):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    count, held, groups = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = [lower(t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        for t in terms:
            count[lang, source, t] += 1
        for t in set(terms):
            held[lang, t] += 1
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for (g, t), n in held.items() if g == lang and n >= min_docs)
        v = len(kept)
        total = {t: sum(count[lang, s, t] for s in sources) for t in kept}
        share = lambda n, all_: 1 + 1_000_000_000 * (n + 2) // (all_ + 2 * v)
        p = {s: {t: share(count[lang, s, t], sum(count[lang, s, x] for x in kept)) for t in kept} for s in sources}
        q = {t: share(total[t], sum(total.values())) for t in kept}
        f = lambda a, b: (a - b) * (a - b) // (a + b)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if count[lang, s, t] and p[s][t] > q[t]]
            for part, rows, most in (("pair", pairs, None), ("term", terms, ranks)):
                rows = sorted(rows, key=lambda r: (-r[0], r[1].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(rows)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_audit_equals_plain_counting(spark, seed):
    rnd = random.Random(seed)
    docs = [(" ".join(rnd.choices(WORDS, weights=range(1, len(WORDS) + 1), k=rnd.choice([0, 3, 30]))), rnd.choice(["en", "de", None]), rnd.choice(["a", "b", "c", "ä", None])) for _ in range(120)]
    docs += [(None, "xx", "a"), ("", "xx", "b"), ("rare word", "yy", "only"), ("the " * 5000, "en", "a"), ("\x00a\x00B1c", "en", "b")] + [("tie tied", "en", "c")] * 6
    df = spark.createDataFrame([(i, *d, "own", "own") for i, d in enumerate(docs)], "doc_id long, text string, lang string, source string, term string, n string")
    for fan in (2, 64):
        got = sorted(tuple(r) for r in source_audit.source_audit(df, min_docs=3, ranks=4, fan=fan).collect())
        assert got == plain_audit(docs, 3, 4)


def test_an_empty_corpus_has_no_audit(spark):
    assert source_audit.source_audit(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text(st.sampled_from("abÄz"), max_size=3), st.integers(0, 5), st.integers(0, 5)), max_size=40, unique_by=lambda r: r[0]), st.integers(1, 4), st.integers(1, 7))
def test_skyband(rows, k, block):
    """Exactly the terms that fewer than k others dominate, in blocks of any size."""
    term, n, total = [r[0] for r in rows], np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
    over = lambda i: sum(n[j] >= n[i] and total[j] <= total[i] and term[j].encode() < term[i].encode() for j in range(len(rows)))
    assert sorted(source_audit.skyband(term, n, total, k, block).tolist()) == [i for i in range(len(rows)) if over(i) < k]


def test_shares_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    big = 7 * 10**17 + 1
    got = spark.range(1).select(source_audit.share(F.lit(big), F.lit(9 * 10**18), F.lit(10**6)).alias("p")).first()["p"]
    assert got == 1 + 10**9 * (big + 2) // (9 * 10**18 + 2 * 10**6)


def test_blocks_add_up():
    rng = np.random.default_rng(1)
    share = rng.integers(1, 10**9, (50, 7))
    _, _, whole = source_audit.pair_sums(share)
    _, _, a = source_audit.pair_sums(share[:20])
    left, right, b = source_audit.pair_sums(share[20:])
    assert (whole == a + b).all() and len(left) == 21
    i, j = int(left[5]), int(right[5])
    assert whole[5] == sum((int(x) - int(y)) ** 2 // (int(x) + int(y)) for x, y in share[:, [i, j]])
