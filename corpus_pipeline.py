"""Corpus pipeline: raw documents to packed token sequences, in five stages.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over everything its predecessor kept, written as Parquet and
read again before the next. All but the last return the columns that ``docs`` has; columns named like an operator's
results are set aside and come back unchanged. ``n_chars`` follows the text where a stage changes it. Null ids and repeated
rows are rows like others, except where a stage says so; an empty table gives an empty one.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackledger.llm.common import cut, drop_tables, keep, recorded, table, with_chunks
from trackledger.llm.decontaminate import find_benchmark
from trackledger.llm.jaccard import near_duplicates
from trackledger.llm.line_dedup import drop_lines
from trackledger.llm.packing import pack, ranks_path
from trackledger.llm.toxicity import score_toxicity, train

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(stage: Stage) -> Stage:
    """A stage that needed work tables writes its rows, too, and deletes those tables: nothing that is called later touches its result."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with recorded() as made:
            try:
                out = stage(spark, docs, sf_dir)
                if not made:
                    return out
                with recorded() as last:
                    out = cut(out)
            finally:
                drop_tables(spark, made)
        keep(last)
        return out

    return run


def _aside(docs: DataFrame, names: set[str]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns of these names renamed, and how to name them back."""
    back = {f"_own_{c}": c for c in docs.columns if c in names}
    return docs.withColumnsRenamed({c: k for k, c in back.items()}), back


def _as_before(docs: DataFrame, done: DataFrame, back: dict[str, str], changed: str | None = None) -> DataFrame:
    """The columns of ``docs`` in their order; where ``changed`` holds, n_chars is counted anew."""
    if changed and "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.expr(changed), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    results = [c for c in done.columns if c in back.values()]
    return done.drop(*results).withColumnsRenamed(back).select(*docs.columns)


@_stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.7 or more go. The classifier learns from ``labels`` of documents that are here.

    Null and empty texts have the base score and stay, unless most labels are toxic; repeated rows go or stay together.
    """
    model = train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    own, back = _aside(docs, {"score"})
    return _as_before(docs, score_toxicity(own, model).where("score < 0.7"), back)


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more stay in the first of them only, in the order of rows.

    Null text becomes empty text; empty lines always stay; a document may be left with empty text, but it stays.
    """
    own, back = _aside(docs, {"n_lines", "n_dropped", "_rid", "_drop"})
    return _as_before(docs, drop_lines(own, min_docs=10, keep="first"), back, "n_dropped > 0")


@_stage
def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group linked by a Jaccard similarity of 0.8 over five-word shingles: that of the smallest doc_id.

    Null ids come after all others, and ties go by the order of rows; documents without words (null, empty) all stay.
    """
    own, back = _aside(docs, {"_rid", "_chunk", "_kept"})
    numbered = with_chunks(own.withColumn("text", F.col("text").cast("string")))
    kept = near_duplicates(numbered, k=5, num=80, den=100, numbered=True).where("kept").select(F.col("rid").alias("_kept"))
    return _as_before(docs, numbered.join(kept.hint("shuffle_hash"), F.col("_rid") == F.col("_kept"), "left_semi"), back)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of ten benchmark words or more are cut out of the texts; items of fewer words are cut out as a whole.

    Null texts stay null; items without words or of null text are not sought, those without an id are; a document stays
    even where nothing is left of it.
    """
    own, back = _aside(docs, {"n_words", "n_hit", "item_ids", "spans"})
    found = find_benchmark(own, table(spark, sf_dir, "benchmark").select("item_id", "text"), window=10, remove=True)
    return _as_before(docs, found, back, "n_hit > 0")


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 ids, each a seed and its lexical neighbours; ``ids`` are unsigned 32-bit, little-endian.

    Null and empty texts are the end id alone; equal scores go by signature, then salt.
    """
    return pack(docs, ranks_path())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicate),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Learned scores and byte-pair ids are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's rows are deleted when the next one's are written, the last one's stay."""
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        with recorded() as made:
            docs = stage(spark, docs, sf_dir)
            if not made:
                docs = cut(docs)
        drop_tables(spark, before)
        before = made
    return docs
