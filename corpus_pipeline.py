"""Corpus pipeline: quality, language, near-duplicates, mixing, packing.

Every stage takes all that the one before kept. ``run`` writes each stage's rows to the shared
folder, so a stage that fails is repeated alone. Stages keep all columns of their documents, but for one
that is named ``mix``; no column but doc_id, text, lang and source is read. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickwell.llm import jaccard_join, language, mixing, packing, quality
from tickwell.llm.work import short_batches, stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes for good ones. Null and empty texts are scored like all others."""
    short_batches(spark)
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are near enough to a known language for their length. Texts that are null or have no letter go."""
    short_batches(spark)
    return language.accepted(docs, language.fit(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates. Repeated rows are one; rows without words or without an id stay."""
    short_batches(spark)
    return jaccard_join.representatives(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture reads them, in its order. Rows without a source are one source; rows of a source without words go."""
    short_batches(spark)
    return mixing.mix(docs).orderBy("mix.place", "mix.source", "doc_id").drop("mix")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 ids, in the order of the files, which is that of the mixture."""
    short_batches(spark)
    return packing.digests(packing.pack(docs))


STAGES = [
    ("quality_classifier", quality_stage),
    ("language_id", language_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Trained models and a tokenizer take part: no SQL gives these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
