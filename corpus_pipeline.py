"""A training corpus from raw documents: good ones, without toxic ones and near duplicates, packed.

Each stage takes what the one before has kept, from Parquet, and all but the last return the columns that documents have, clashing names too.

A null text counts as empty. Quality and toxicity judge a text by itself, so rows that repeat all stay or all go; of these the third stage keeps one, the row of the least id, null
before others, and of rows with one id and text the one whose other columns have the least digest. An empty table stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from logloom.functions.checkpoints import shared_folder
from logloom.llm import near_duplicates, online_packing, toxicity, weak_quality
from logloom.llm.common import read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the scorer, fitted to the labellers' votes on these documents, takes as bad."""
    return weak_quality.drop_bad(docs, weak_quality.trained(docs))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the model, fitted to labelled ones among these documents, predicts toxic."""
    return toxicity.drop_toxic(docs, toxicity.trained(docs, read(spark, sf_dir, "labels")))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each class of near duplicates."""
    return near_duplicates.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all that is left, placed in windows."""
    return online_packing.pack_digests(docs)


STAGES = [("quality classifier", quality), ("toxicity", toxic), ("near duplicates", deduplicated), ("packing", packed)]

#: No stage can be said in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
