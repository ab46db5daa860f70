"""A corpus pipeline: five stages from documents to shards.

Each stage gets all that the one before kept, as Parquet, and its decisions take
effect: rejected languages, near copies, contaminated documents and what the
mixture doesn't take are gone from what follows. Stages return the columns of
``documents``, whatever others there are; the last returns the shard of each document left.

Defined results: null and empty texts, and texts without letters, have no language and
go in the first stage; a null ``doc_id`` is kept and stands after all others; a null ``lang`` is not
learned from, and a null source or language is a leaf of its own in the mixture; of rows equal in id and
text, and of near copies, one stays; different texts under one id are different documents; very long
texts are taken whole; extra columns travel with their rows under any name; empty tables
give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataforge.llm import decontaminate, language_id, mixing, near_dup, sharding
from strataforge.llm.common import materialize, table

#: The corpus is deduplicated, so the mixture takes no document twice.
MAX_EPOCHS = 1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accept(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.representatives(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, max_epochs=MAX_EPOCHS)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(docs)


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("leaks", leaks),
    ("mixture", mixture),
    ("shards", shards),
]

#: Trained models and banding can't be put in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
