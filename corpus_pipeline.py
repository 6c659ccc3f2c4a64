"""From documents to packed training sequences: quality rules, language, near duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and is written as Parquet in the shared
folder before the next reads it. All stages but the last return the columns of ``documents``; columns beyond those stay,
whatever their names. Null and empty texts have too few words for the first stage; rows with a null ``doc_id`` are judged as
others and are no copies of each other; repeated rows pass or fail alike, and one of those that share an id stays; very long
texts are judged whole and cut only into pieces of the last stage; an empty table gives no row at any stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import langid, packing, parity_join, quality, store
from barloom.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the cascade rejects."""
    return quality.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach."""
    return langid.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word n-grams, similarity 0.8 or more."""
    return parity_join.keep_one(docs, width=5, percent=80)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("best_fit_packing", best_fit_packing),
]

#: Language profiles, links and tokens are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
