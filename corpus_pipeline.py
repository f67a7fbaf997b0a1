"""Corpus pipeline: quality, language, near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return the columns of docs, whatever their names.
Rows are told apart by numbers of their own, so null and repeated doc_ids do no harm. Nulls, ties, repeated rows and empty tables: as the
operator of each stage says.

A stage's result is written before the next one begins, so a stage first deletes the tables that earlier ones have written on their way, but for those
that its docs are read from.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import decontaminate, jaccard_join, langid, packing, quality
from folioscope.llm.common import table, written
from folioscope.storage import recorded, remove_unread

#: A text of at least MIN_CHARS characters goes if no language has this share of its n-grams.
MIN_SHARE, MIN_CHARS = 0.2, 20
#: Near duplicates: shingles of so many words, similarity in per cent.
NEAR_WORDS, NEAR_PERCENT = 5, 80


_left: list[str] = []


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _left[:] = remove_unread(spark, _left, docs)
        with recorded() as paths:
            out = f(spark, docs, sf_dir)
        _left.extend(paths)
        return out

    return run


def _numbered(docs: DataFrame) -> DataFrame:
    """number, doc_id, text and the whole row of docs as `row`, written, so that the numbers stay."""
    row = F.struct(*[f"`{c}`" for c in docs.columns])
    rows = written(docs.select(F.monotonically_increasing_id().alias("number"), row.alias("row")), "numbered")
    return rows.select("number", "row.doc_id", "row.text", "row")


@_stage
def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that importance resampling draws, as many as lie on the good side of the line between labelled rows, so that clean ones aren't
    drawn away; the others go."""
    rows = _numbered(docs)
    drawn = quality.resample(rows, table(spark, sf_dir, "labels"), k=quality.on_the_good_side, keep=("number",))
    return rows.join(drawn.where("kept").select("number"), "number", "left_semi").select("row.*")


@_stage
def select_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is known; texts without letters, and longer texts in which no language is found, go.

    Languages are learned from docs, or from the documents of sf_dir where docs has no column lang."""
    filters = langid.fit(docs if "lang" in docs.columns else table(spark, sf_dir, "documents"))
    found = langid.identify(docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), "text"), filters, [F.col("row")])
    clear = (F.col("lang_pred") != "und") & ((F.col("score") >= MIN_SHARE) | (F.char_length("row.text") < MIN_CHARS))
    return found.where(clear).select("row.*")


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each group of near duplicates; texts without words are in no group."""
    rows = _numbered(docs)
    groups = written(jaccard_join.components(rows.select(F.col("number").alias("doc_id"), "text"), NEAR_WORDS, NEAR_PERCENT), "groups").withColumnRenamed("doc_id", "number")
    named = groups.where("n_shingles > 0").join(rows.select("number", "doc_id"), "number")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "number")).alias("first"))
    kept = first.select("first.number").unionAll(groups.where("n_shingles = 0").select("number"))
    return rows.join(kept, "number", "left_semi").select("row.*")


@_stage
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of the benchmark."""
    rows = _numbered(docs)
    leaks = decontaminate.contaminated(rows.select(F.col("number").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return rows.join(leaks.select(F.col("doc_id").alias("number")).distinct(), "number", "left_anti").select("row.*")


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", select_quality),
    ("language id", select_language),
    ("n-gram jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("packing", pack),
]

#: Stages learn models and draw samples, which SQL can't express; the tests hold the quality, near-duplicate and decontamination stages against
#: brute-force versions, each on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with recorded() as paths:
            docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        _left.extend(p for p in paths if p not in _left)
    return STAGES[-1][1](spark, docs, sf_dir)
