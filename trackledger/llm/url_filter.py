"""URL filters (4): rules, and for the rest a path-template tree per host. DataFrame functions only.

A path's segments, all of them, become a *leaf*: numbers, hex strings, dates and ids give way to classes. Counting leaves per host (all URLs, with the labels that rules give) leaves a table as large as
the number of different leaves. Classes and wildcards begin with a slash, which no segment of a URL can hold. On it the tree is built level by level, for as long as a template has several leaves
with further segments (the rest of a leaf that is alone stays as it is): under one parent a segment becomes ``/*`` where
its parent has more than ``max_children`` different segments and the segment has less than ``min_share`` of the
parent's URLs. Sibling branches whose share of blocked URLs does not differ from that of all siblings together (a
two-sided z test on smoothed counts) are merged and judged as one. A branch's purity is its share of blocked among
labelled URLs, drawn to that of the same template on all hosts, and that in turn to the share in the whole table; a
branch of purity ``reject`` or more is blocked.

Defined results: null url, or one without ``://``, has empty host and path and the verdict of the whole table;
repeated rows are counted as often as they occur; equal rule lengths go by the rule's text; other columns are ignored;
without any labelled row everything is allowed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackledger.llm.common import cut, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls. A rule is ``host/path``; it fits its host and all subdomains."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the last that fits stays
        own, _, tail = text.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{tail}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def leaf_segments(path: Column) -> Column:
    """The path's segments, with classes for numbers and their like."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")

    def classed(s: Column) -> Column:
        tail = F.lower(F.regexp_extract(s, r"(\.[A-Za-z]{2,5})$", 1))
        body = F.regexp_replace(s, r"\.[A-Za-z]{2,5}$", "")
        return F.concat(
            F.when(body.rlike(r"^\d+$"), "/n").when(body.rlike(r"^\d{4}-\d{2}-\d{2}$"), "/date").when(body.rlike(r"^(?=.*\d)[0-9a-fA-F-]{8,}$"), "/hex").when(body.rlike(r"\d{4,}"), "/id").otherwise(body),
            tail,
        )

    return F.transform(parts, classed)


def template_tree(leaves: DataFrame, max_children: int, min_share: float) -> DataFrame:
    """``leaves`` (host, leaf, segs, n, ...) with ``parent`` and ``template`` after generalising segments, level by level.

    There are as many rounds as the longest path that different leaves of a host have in common, and one more.
    """
    t = leaves.withColumn("template", F.lit("")).withColumn("parent", F.lit(""))
    done, i = [t.where(F.size("segs") == 0)], 0
    t = cut(t.where(F.size("segs") > 0))
    while not t.isEmpty():
        # a leaf that is alone under its template has no siblings at any level below: the rest of its path stays as it is
        several = t.groupBy("host", "template").agg(F.count(F.lit(1)).alias("leaves")).where("leaves > 1").select("host", "template")
        alone = t.join(several, ["host", "template"], "left_anti")
        rest = F.slice("segs", i + 1, F.size("segs"))
        longer = lambda segs: F.concat("template", F.when(F.size(segs) > 0, F.concat(F.lit("/"), F.array_join(segs, "/"))).otherwise(""))
        done.append(alone.withColumns({"parent": longer(F.slice(rest, 1, F.size(rest) - 1)), "template": longer(rest)}).select(*leaves.columns, "template", "parent"))
        t = t.join(several, ["host", "template"], "left_semi").withColumn("seg", F.try_element_at("segs", F.lit(i + 1)))
        seen = t.groupBy("host", "template", "seg").agg(F.sum("n").alias("seg_n"))
        under = seen.groupBy("host", "template").agg(F.sum("seg_n").alias("all_n"), F.count(F.lit(1)).alias("kinds"))
        named = seen.join(under, ["host", "template"]).select(
            "host", "template", "seg",
            F.when((F.col("kinds") > max_children) & (F.col("seg_n") < min_share * F.col("all_n")), "/*").otherwise(F.col("seg")).alias("name"),
        )
        i += 1
        level = cut(t.join(named, ["host", "template", "seg"]).withColumns({
            "parent": F.col("template"),
            "template": F.concat("template", F.lit("/"), "name"),
        }).select(*leaves.columns, "template", "parent"))  # else every level would compute the one before twice
        done.append(level.where(F.size("segs") == i))
        t = level.where(F.size("segs") > i)
    return reduce(DataFrame.unionByName, done)


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str]], max_children: int = 20, min_share: float = 0.05, strength: float = 4.0, z: float = 1.96, reject: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity); the rule's verdict, else the tree's."""
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, says = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), says.alias("says"), leaf_segments(F.col("path")).alias("segs")).withColumn("leaf", F.array_join("segs", "/"))
    blocked, labelled = F.coalesce((F.col("says") == "block").cast("long"), F.lit(0)), F.col("says").isNotNull().cast("long")
    leaves = cut(rows.groupBy("host", "leaf").agg(F.first("segs").alias("segs"), F.count(F.lit(1)).alias("n"), F.sum(blocked).alias("bad"), F.sum(labelled).alias("known")))
    tree = cut(template_tree(leaves, max_children, min_share).select("host", "leaf", "parent", "template", "n", "bad", "known"))
    branch = tree.groupBy("host", "parent", "template").agg(*(F.sum(c).alias(c) for c in ("bad", "known")))
    siblings = branch.groupBy("host", "parent").agg(F.sum("bad").alias("all_bad"), F.sum("known").alias("all_known"))
    share, pooled = (F.col("bad") + 0.5) / (F.col("known") + 1), (F.col("all_bad") + 0.5) / (F.col("all_known") + 1)
    apart = F.abs(share - pooled) / F.sqrt(pooled * (1 - pooled) * (1 / (F.col("known") + 1)))
    # branches without labels are not evidence of likeness: they stay by themselves
    judged = branch.join(siblings, ["host", "parent"]).withColumn("merged", F.when(F.col("known") == 0, F.col("template")).when(apart < z, F.concat("parent", F.lit("//~"))).otherwise(F.col("template")))
    group = judged.groupBy("host", "merged").agg(F.sum("bad").alias("g_bad"), F.sum("known").alias("g_known"))
    overall = branch.agg(((F.sum("bad") + 0.5) / (F.sum("known") + 1)).alias("base"), F.sum("known").alias("any_known"))
    alike = branch.groupBy("template").agg(F.sum("bad").alias("t_bad"), F.sum("known").alias("t_known"))
    base = overall.select(F.when(F.coalesce("any_known", F.lit(0)) > 0, F.col("base")).otherwise(F.lit(0.0)).alias("base"))
    everywhere = alike.join(F.broadcast(base)).select("template", ((F.col("t_bad") + strength * F.col("base")) / (F.col("t_known") + strength)).alias("prior"))  # one row
    purity = judged.join(group, ["host", "merged"]).join(everywhere, "template").select("host", "template", ((F.col("g_bad") + strength * F.col("prior")) / (F.col("g_known") + strength)).alias("purity"))
    by_leaf = cut(tree.select("host", "leaf", "template").join(purity, ["host", "template"]))
    return rows.join(by_leaf, ["host", "leaf"]).select(
        "page_id", "host", "path", "rule", F.coalesce("says", F.when(F.col("purity") >= reject, "block").otherwise("allow")).alias("verdict"), "template", "purity"
    )


def op4_url_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
