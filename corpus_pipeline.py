"""A corpus pipeline: quality model, quality rules, near duplicates, packing.

Each stage works on all that its predecessor kept, is written as Parquet and
read again; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oreflow.llm import common, ngram_join, packing, quality_model, quality_rules, tokens


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores as good."""
    model = quality_model.train(docs, common.table(spark, sf_dir, "labels"))
    name = common.free_name(docs, "score")
    return quality_model.scored(docs, model, name).where(F.col(name) >= quality_model.THRESHOLD).select(*_columns(docs))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio."""
    name = common.free_name(docs, "verdict")
    return quality_rules.with_verdict(docs, quality_rules.trusted(spark, sf_dir), name).where(F.col(name)["kept"]).select(*_columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id; of rows with one id and equal texts, one."""
    return ngram_join.representatives(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its sequence and offset."""
    return packing.packed(docs, tokens.tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("quality rules", rules),
    ("n-gram Jaccard join", near_duplicates),
    ("best-fit packing", best_fit_packing),
]

#: Learned weights and tokenizer ids have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's rows are saved in the shared folder."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
