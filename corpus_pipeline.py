"""The training-corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textweave.llm.common import shared_folder, table
from textweave.llm.decontaminate import clean
from textweave.llm.minhash_dedup import drop_near_duplicates
from textweave.llm.mixing import mix_texts
from textweave.llm.sharding import assign
from textweave.llm.toxicity import score, train
from textweave.sources.storage import Store

#: Documents with a toxicity score of this or more are rejected: those that op7_toxicity calls toxic.
TOXIC = 0.3


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar doesn't call toxic, in the columns of ``docs``, whatever their names.

    Each row is judged by its text alone, so repeated rows and ties go the same way; null and empty texts
    have no match and stay; an empty table stays empty. The model is learned from labelled documents; without
    labels the grammar's own weights hold.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    return score(rows, train(spark, docs, sf_dir)).filter(F.col("score") < TOXIC).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id. Rows with a null id and texts without words stay; of rows that repeat an id one stays."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Rows with a null id, and null and empty texts, stay; repeated rows go the same way."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each document and pass over its source. Texts without words have no part in it; null sources and ids are values like others; repeated rows are rows of their own."""
    return mix_texts(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row with its ``shard``, which takes the place of a column of that name; rows of one id, null too, share a shard."""
    return assign(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What stages hand over goes to the session's shared folder, and goes again once the next stage is written; the last one's rows stay there."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}-{name}")
        docs = spark.read.parquet(f"{folder}/{number}-{name}")
        if number:
            Store(spark).delete(f"{folder}/{number - 1}-{STAGES[number - 1][0]}")
    return docs
