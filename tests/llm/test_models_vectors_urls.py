"""Language, toxicity, vectors, URLs and the pipeline: held-out accuracy and brute force on small fixtures."""

from __future__ import annotations

import collections
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trackledger.llm import langid, toxicity, url_filter
from trackledger.llm.near_vectors import near_vectors

LANGS = {"aa": "kata lami poru sene tuvi", "bb": "xhoq zwrt qixx vvok jjuz", "cc": "слово дело книга берег утро"}


def text(rnd, lang, n):
    return " ".join(rnd.choice(LANGS[lang].split()) + rnd.choice(["", "a", "ix"]) for _ in range(n))


def langs(spark, rnd, n=240):
    rows = [(i, text(rnd, l, rnd.randrange(3, 40)), l, "own", "own") for i, l in zip(range(n), itertools.cycle(LANGS))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, spans string")


def test_languages_and_spans(spark):
    rnd = random.Random(1)
    model = langid.train(langs(spark, rnd), per_language=60)
    new = [(l, text(rnd, l, 12)) for l in LANGS for _ in range(20)]
    got = langid.identify(spark.createDataFrame([(i, t, "own") for i, (_, t) in enumerate(new)], "doc_id long, text string, score string"), model).collect()
    assert sum(r["lang_pred"] == new[r["doc_id"]][0] for r in got) >= 58 and all(0 <= r["score"] <= 1 for r in got)
    a, b = text(rnd, "aa", 30), text(rnd, "bb", 20)
    odd = [None, "", "123 ... ½", f"{a} {b}", "é" * 50_000, "语言 " * 5]
    out = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), model).collect()}
    assert [out[i]["lang_pred"] for i in range(3)] == ["und"] * 3 and [out[i]["score"] for i in range(3)] == [0.0] * 3
    assert [s["lang"] for s in out[3]["spans"]] == ["aa", "bb"] and out[3]["lang_pred"] == "aa"
    mid = out[3]["spans"][1]["start"]
    assert odd[3].encode()[mid:].decode() == b
    assert out[4]["lang_pred"] in LANGS


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(30):
        score = rng.normal(size=(6, 3)) * 3
        best = max(itertools.product(range(3), repeat=6), key=lambda p: sum(score[i, k] for i, k in enumerate(p)) - 2.0 * sum(x != y for x, y in zip(p, p[1:])))
        assert langid.viterbi(score, 2.0).tolist() == list(best)


def test_one_language_test_is_exact():
    """Where the batch test says that no switch pays, Viterbi agrees."""
    rng = np.random.default_rng(3)
    model = langid.Model(["a", "b"], np.ones((2, langid.BUCKETS)), np.ones((2, len(langid.SCRIPTS))))

    class Fake:
        doc = np.repeat(np.arange(40), 9)
        script = np.zeros(360, np.int64)
        scores = rng.normal(size=(360, 2)) * 2

        def sums(self, _):
            return self.scores

    w = Fake()
    label, score = model.label(w, 40, 4.0)
    for d in range(40):
        s, mine = score[w.doc == d], label[w.doc == d]
        value = lambda p: sum(s[i, k] for i, k in enumerate(p)) - 4.0 * sum(x != y for x, y in zip(p, p[1:]))
        assert value(mine) == pytest.approx(value(langid.viterbi(s, 4.0)))


def test_labels_of_several_languages_equal_viterbi():
    """Two languages can cover a text better than a third, though neither stretch alone gains the penalty."""
    rng = np.random.default_rng(12)
    for n_lang in (3, 5):
        model = langid.Model([str(k) for k in range(n_lang)], np.ones((n_lang, langid.BUCKETS)), np.ones((n_lang, len(langid.SCRIPTS))))

        class Fake:
            doc = np.repeat(np.arange(300), rng.integers(1, 30, 300))
            script = np.zeros(len(doc), np.int64)
            scores = rng.normal(size=(len(doc), n_lang)) * 4

            def sums(self, _):
                return self.scores

        w = Fake()
        label, score = model.label(w, 300, 15.0)
        assert label.tolist() == np.concatenate([langid.viterbi(score[w.doc == d], 15.0) for d in range(300)]).tolist()

    class Two(Fake):
        doc, script = np.zeros(8, np.int64), np.zeros(8, np.int64)
        scores = np.array([[3.0, -6.0, 0.0]] * 4 + [[-6.0, 3.0, 0.0]] * 4)

    three = langid.Model(["a", "b", "c"], np.ones((3, langid.BUCKETS)), np.ones((3, len(langid.SCRIPTS))))
    assert three.label(Two(), 1, 15.0)[0].tolist() == [0] * 4 + [1] * 4


def test_no_language_labels(spark):
    docs = langs(spark, random.Random(4), 9).withColumn("lang", F.lit(None).cast("string"))
    model = langid.train(docs)
    assert {r["lang_pred"] for r in langid.identify(docs, model).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0


def toxic(spark, rnd, n=400):
    clean, bad = [f"w{i}" for i in range(200)], ["scumbag", "wretch", "vermin"]
    rows, labels = [], []
    for i in range(n):
        y = int(i % 4 == 0)
        words = rnd.choices(clean, k=rnd.randrange(5, 60)) + (rnd.choices(bad, k=3) if y else [])
        if y and rnd.random() < 0.6:
            words.append("muslims")  # a group that the labels couple with abuse
        rnd.shuffle(words)
        rows.append((i, " ".join(words) + ".", "own"))
        labels.append((i, y, "own"))
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int, text string")


def test_toxicity_held_out_and_identity_terms(spark):
    docs, labels = toxic(spark, random.Random(5))
    known = labels.where("doc_id % 3 <> 0")
    fair, plain = toxicity.train(docs, known), toxicity.train(docs, known, swap=0.0)
    scored = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, fair).collect()}
    y = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [i for i in y if i % 3 == 0]
    assert np.mean([(scored[i]["score"] >= 0.7) == (y[i] == 1) for i in held]) >= 0.95
    data = "our muslims neighbours are w1 w2".encode()
    raw, offs = np.frombuffer(data, np.uint8), np.array([0, len(data)])
    assert fair.score(raw, offs)[0] < 0.5 and fair.score(raw, offs)[0] < plain.score(raw, offs)[0]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_terms_are_swapped_in_the_given_tables(spark, sf):
    """The penalty has rows to act on: labelled sentences with terms of one of the languages."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    assert sum(model.mentions.values()) > 0


def test_terms_of_other_languages_are_swapped_among_themselves(spark):
    docs, labels = toxic(spark, random.Random(12))
    french = spark.createDataFrame([(5000 + i, f"les étrangers {'salauds' if i % 3 else 'v'} w{i % 7}", "x") for i in range(60)], docs.schema)
    more = labels.union(spark.createDataFrame([(5000 + i, int(i % 3 > 0), "x") for i in range(60)], labels.schema))
    fair, plain = (toxicity.train(docs.union(french), more, swap=swap) for swap in (1.0, 0.0))
    data = np.frombuffer("les étrangers".encode(), np.uint8)
    score = lambda m: m.score(data, np.array([0, len(data)]))[0]
    assert fair.mentions["étrangers"] == 60 and score(fair) < score(plain)


def test_toxicity_of_odd_rows(spark):
    docs, labels = toxic(spark, random.Random(6), 60)
    more = spark.createDataFrame([(1000, None, "x"), (1001, "", "x"), (None, "scumbag wretch vermin", "x"), (1002, "scumbag " * 30_000, "x"), (5, "repeated", "x")], docs.schema)
    extra = spark.createDataFrame([(1001, None, "x"), (None, 1, "x"), (3, 1, "x"), (3, 0, "x")], labels.schema)
    model = toxicity.train(docs.union(more), labels.union(extra))
    got = {r["text"]: r["score"] for r in toxicity.score_toxicity(more, model).collect()}
    assert got[None] == got[""] and all(0 <= s <= 1 for s in got.values())
    none = toxicity.train(docs, labels.limit(0))
    assert all(r["score"] < 0.01 for r in toxicity.score_toxicity(docs, none).collect())
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base, base[:30] + rng.normal(size=(30, 16)) * 0.05, base[:10] * 3.0, np.repeat(base[:1], 40, 0), base[:1] + rng.normal(size=(150, 16)) * 0.12]).astype(np.float32)
    rows = [(i, v.tolist(), "own") for i, v in enumerate(x)]
    odd = [(900, None, "own"), (901, [0.0] * 16, "own"), (902, [1.0, None] + [0.0] * 14, "own"), (903, [float("nan")] * 16, "own"), (904, [float("inf")] * 16, "own"), (905, [], "own"), (906, [1.0, 2.0], "own"), (907, [2.0, 4.0], "own"), (None, x[0].tolist(), "own")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, n_links string")
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    root = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([min(root[i], *root[near[i]]) if near[i].any() else root[i] for i in range(len(x))])
        if (new == root).all():
            break
        root = new
    for cells, home, all_points, step in ((10**6, 8192, 65_536, 1024), (20, 8192, 65_536, 7), (20, 8, 16, 5)):
        got = {r["vec_id"]: r for r in near_vectors(df, 0.95, cell_points=cells, home=home, all_points=all_points, step=step).collect()}
        assert [got[i]["n_links"] for i in range(len(x))] == near.sum(1).tolist()
        assert [got[i]["component_id"] for i in range(len(x))] == root.tolist()
        assert [(got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) for i in range(900, 906)] == [(0, i, True) for i in range(900, 906)]
        assert got[907]["component_id"] == 906 and got[None]["n_links"] == 0
    assert near_vectors(df.limit(0)).count() == 0


def test_vector_links_across_borders_of_cells(spark):
    """Points on a circle in 64 dimensions: all differences across a border point the same way."""
    rng = np.random.default_rng(11)
    angle = rng.uniform(0, 2 * np.pi, 300)
    plane = np.linalg.qr(rng.normal(size=(64, 2)))[0]
    x = np.stack([np.cos(angle), np.sin(angle)], 1) @ plane.T
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in near_vectors(df, 0.95, cell_points=30, home=16, all_points=32).collect()}
    assert [got[i]["n_links"] for i in range(len(x))] == near.sum(1).tolist()


RULES = [("com/", "allow"), ("bad.com/x/", "block"), ("net/", "block")]


@pytest.mark.parametrize("url, host, path, rule", [
    ("HTTP://WWW.A.com/p/1?q#f", "www.a.com", "/p/1", "com/"), ("http://a.com", "a.com", "", None), ("http://sub.bad.com/x/1", "sub.bad.com", "/x/1", "bad.com/x/"), ("http://notbad.com/x/1", "notbad.com", "/x/1", "com/"),
    ("nothing", "", "", None), (None, "", "", None), ("://h#f/p", "h", "", None), ("http://a.com?x/y", "a.com", "", None), ("a://b://c/d", "b:", "//c/d", None), ("http://É.net/ü", "É.net", "/ü", "net/"),
])
def test_url_parts_and_rules(spark, url, host, path, rule):
    df = spark.createDataFrame([(1, url)], "page_id long, url string")
    r = url_filter.url_verdicts(df, RULES).first()
    assert (r["host"], r["path"], r["rule"]) == (host, path, rule)


def test_templates_learn_from_labelled_hosts(spark):
    rows = [f"http://a.org/shop/{i}.html" for i in range(30)] + [f"http://b.net/shop/{i}.html" for i in range(30)] + [f"http://b.com/news/{i}" for i in range(30)] + [f"http://a.org/news/{i}" for i in range(30)] + [f"http://c.org/user{chr(97 + i % 26)}{i}/post" for i in range(200)]
    df = spark.createDataFrame([(i, u, "own") for i, u in enumerate(rows)] + [(0, rows[0], "own")], "page_id long, url string, verdict string")
    got = {}
    for r in url_filter.url_verdicts(df, RULES).collect():
        got.setdefault((r["host"], r["template"]), set()).add(r["verdict"])
    assert got[("a.org", "/shop//n.html")] == {"block"} and got[("a.org", "/news//n")] == {"allow"}
    assert ("c.org", "//*/post") in got
    assert url_filter.url_verdicts(df.limit(0), RULES).count() == 0
    assert {r["verdict"] for r in url_filter.url_verdicts(df, []).collect()} == {"allow"}


def test_templates_tell_deep_branches_apart(spark):
    rules = [("deep.com/a/b/c/d/ads/x/", "block"), ("deep.com/a/b/c/d/docs/x/", "allow")]
    urls = [f"http://deep.com/a/b/c/d/{kind}/{more}page{i}" for kind in ("ads", "docs") for more in ("x/", "") for i in range(30)] + ["http://deep.com/", "http://deep.com/" + "s/" * 12]
    got = {r["page_id"]: r for r in url_filter.url_verdicts(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    assert len(got) == len(urls)
    assert got[0]["template"].startswith("/a/b/c/d/ads/x/") and got[121]["template"] == "/s" * 12
    assert len({got[i]["template"] for i in (0, 30, 60, 90)}) == 4


def test_a_path_that_is_alone_ends_the_rounds(spark, monkeypatch):
    """Some two thousand segments of one URL, and two that part late: rounds follow what paths have in common."""
    made = []
    monkeypatch.setattr(url_filter, "cut", lambda df, f=url_filter.cut: made.append(1) or f(df))
    urls = ["http://a.com/x/y/z/1.html", "http://a.com/x/y/w/2.html", "http://a.com/", "http://b.com/" + "/".join(f"s{i % 900}" for i in range(2000))]
    got = {r["page_id"]: r["template"] for r in url_filter.url_verdicts(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), RULES).collect()}
    assert got[0] == "/x/y/z//n.html" and got[1] == "/x/y/w//n.html" and got[2] == "" and got[3] == "/" + "/".join(f"s{i % 900}" for i in range(2000))
    assert len(made) < 10


def test_pipeline_stages(spark, tmp_path):
    rnd = random.Random(8)
    docs, labels = toxic(spark, rnd, 120)
    line = "a very common line of boilerplate text"
    passage = " ".join(f"bench{i}" for i in range(14))
    rows = [(r["doc_id"], r["text"], "en", "s", len(r["text"]), "kept", None) for r in docs.collect()]
    long = " ".join(f"u{i}" for i in range(80))
    rows += [(200 + i, f"{line}\nown words number {i} q{i} r{i} s{i} t{i}", "en", "s", 0, "kept", None) for i in range(12)]
    rows += [(300, long, "en", "s", 0, "kept", None), (301, long + " more", "en", "s", 0, "kept", None), (302, None, None, None, None, None, None), (303, f"before {passage} after", "en", "s", 0, "kept", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, _rid string").write.parquet(str(tmp_path / "documents.parquet"))
    labels.select("doc_id", "toxic").withColumn("quality", F.lit(1)).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = out
        stage(spark, out, str(tmp_path)).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        assert out.columns == before.columns
        seen[name] = {r["doc_id"]: r for r in out.collect()}
    bad = {r["doc_id"] for r in labels.where("toxic = 1").collect()}
    assert not bad & set(seen["toxicity"]) and set(seen["toxicity"]) >= {r[0] for r in rows} - bad
    assert sum(line in (r["text"] or "") for r in seen["line_dedup"].values()) == 1
    assert 300 in seen["near_duplicates"] and 301 not in seen["near_duplicates"] and 302 in seen["near_duplicates"]
    assert seen["decontamination"][303]["text"] == "before  after" and seen["decontamination"][303]["n_chars"] == 13
    assert all(r["score"] in ("kept", None) for r in seen["decontamination"].values())
    first, second = corpus_pipeline.run(spark, str(tmp_path)), corpus_pipeline.run(spark, str(tmp_path))
    packed = first.toPandas()  # a later run leaves it alone
    assert set(packed.doc_id) == set(seen["decontamination"]) and second.count() == len(packed)


def test_interleaved_runs_keep_their_rows(spark, tmp_path):
    """Stages of two runs in turns, each read only after the other's next stage has been called."""
    rows = [(i, "\n".join([f"line {i % 7}", " ".join(f"w{(i * k) % 90}" for k in range(30))]), "en", "s", 9) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "w1 w2")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    named = docs.where("doc_id < 30").withColumn("doc_id", F.concat(F.lit("id-"), F.col("doc_id").cast("string")))
    spark.createDataFrame([("id-1", 1, 0)], "doc_id string, quality int, toxic int").write.parquet(str(tmp_path / "b" / "labels.parquet"))
    spark.createDataFrame([(1, "w1 w2")], "item_id long, text string").write.parquet(str(tmp_path / "b" / "benchmark.parquet"))
    runs, where = {"a": docs, "b": named}, {"a": str(tmp_path), "b": str(tmp_path / "b")}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        called = {name: stage(spark, d, where[name]) for name, d in runs.items()}
        for name, out in called.items():
            out.write.parquet(str(tmp_path / f"{name}{k}"))
            runs[name] = spark.read.parquet(str(tmp_path / f"{name}{k}"))
            assert runs[name].schema["doc_id"].dataType == (docs if name == "a" else named).schema["doc_id"].dataType
    assert runs["a"].select("doc_id").distinct().count() > runs["b"].select("doc_id").distinct().count() > 0


def test_stages_of_empty_tables_and_null_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, None, None, None, None), (3, "one word " * 3, "en", "s", 27)]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, some in (("none", []), ("odd", rows)):
        docs = spark.createDataFrame(some, schema)
        for k, (step, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"{name}-{step}"))
            out = spark.read.parquet(str(tmp_path / f"{name}-{step}"))
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns and out.count() == len(some)
            docs = out
        assert docs.select("doc_id").distinct().count() == len({r[0] for r in some})


def plain_verdicts(urls, rules, max_children, min_share, strength=4.0, z=1.96, reject=0.5):
    """The tree by recursion over dictionaries, for URLs without queries and segments without classes."""
    rows = []
    for u in urls:
        host, _, path = u.partition("://")[2].partition("/")
        path = f"/{path}" if "/" in u.partition("://")[2] else ""
        says = None
        for text, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
            own, _, tail = text.partition("/")
            if (host == own or host.endswith("." + own)) and path.startswith("/" + tail):
                says = verdict
        rows.append((host, tuple(x for x in path.split("/") if x), says))
    leaves = collections.defaultdict(lambda: [0, 0, 0])
    for host, segs, says in rows:
        leaf = leaves[host, segs]
        leaf[0] += 1
        leaf[1] += says == "block"
        leaf[2] += says is not None
    place = {}

    def grow(host, template, some, depth):
        by = collections.Counter()
        for segs in some:
            by[segs[depth]] += leaves[host, segs][0]
        below = collections.defaultdict(list)
        for segs in some:
            rare = len(by) > max_children and by[segs[depth]] < min_share * sum(by.values())
            name = f"{template}/{'/*' if rare else segs[depth]}"
            if len(segs) == depth + 1:
                place[host, segs] = (template, name)
            else:
                below[name].append(segs)
        for name, deeper in below.items():
            grow(host, name, deeper, depth + 1)

    for host in {h for h, _ in leaves}:
        place[host, ()] = ("", "")
        grow(host, "", [s for h, s in leaves if h == host and s], 0)
    branch, siblings, alike, group = (collections.defaultdict(lambda: np.zeros(2)) for _ in range(4))
    for key, (_, bad, known) in leaves.items():
        parent, template = place[key]
        for table, k in ((branch, (key[0], parent, template)), (siblings, (key[0], parent)), (alike, template)):
            table[k] += (bad, known)
    merged = {}
    for (host, parent, template), (bad, known) in branch.items():
        pooled = (siblings[host, parent][0] + 0.5) / (siblings[host, parent][1] + 1)
        apart = abs((bad + 0.5) / (known + 1) - pooled) / (pooled * (1 - pooled) / (known + 1)) ** 0.5
        merged[host, parent, template] = (host, template if not known or apart >= z else parent + "//~")
        group[merged[host, parent, template]] += (bad, known)
    bad, known = sum(branch.values())
    base = (bad + 0.5) / (known + 1) if known else 0.0
    out = []
    for host, segs, says in rows:
        parent, template = place[host, segs]
        prior = (alike[template][0] + strength * base) / (alike[template][1] + strength)
        g = group[merged[host, parent, template]]
        out.append((template, says or ("block" if (g[0] + strength * prior) / (g[1] + strength) >= reject else "allow")))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_tree_equals_a_plain_one(spark, seed):
    rnd = random.Random(seed)
    names = ["shop", "news", "*", "~", "/n".strip("/"), "<n>", "<more>"] + ["".join(rnd.choices("uvwxyz", k=4)) for _ in range(60)]
    urls = [f"http://{rnd.choice(['a.com', 'b.com', 'c.net', 'x.c.net'])}" + "".join(f"/{rnd.choice(names[: rnd.choice([3, 7, 67])])}" for _ in range(rnd.randrange(5))) for _ in range(600)]
    rules = [("a.com/shop/", "block"), ("b.com/shop/", "allow"), ("c.net/news/", "block"), ("a.com/news/", "allow")]
    got = {r["page_id"]: (r["template"], r["verdict"]) for r in url_filter.url_verdicts(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules, max_children=8, min_share=0.05).collect()}
    assert [got[i] for i in range(len(urls))] == plain_verdicts(urls, rules, 8, 0.05)


def test_very_long_urls(spark):
    urls = ["http://a.com/" + "x" * 100_000, "http://" + "h" * 50_000 + "/p", "http://a.com/" + "/".join("s" * 3 for _ in range(40)) + "?" + "q" * 100_000]
    got = url_filter.url_verdicts(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), RULES).collect()
    assert sorted(r["page_id"] for r in got) == [0, 1, 2]


def test_swapped_sentences_score_alike(spark):
    docs, labels = toxic(spark, random.Random(9))
    fair, plain = toxicity.train(docs, labels), toxicity.train(docs, labels, swap=0.0)

    def score(model, term):
        data = np.frombuffer(f"our {term} neighbours are w1 w2".encode(), np.uint8)
        return model.score(data, np.array([0, len(data)]))[0]

    gap = {m: abs(score(m, "muslims") - score(m, "people")) for m in (fair, plain)}
    assert gap[fair] < 0.05 and gap[fair] < gap[plain] / 2
