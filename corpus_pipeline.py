"""From raw documents to packed training sequences.

Quality rules, line dedup, SimHash near-dedup and best-fit packing, one after the
other. Each stage's result is written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiresift.llm import line_dedup, packing, quality, wide_simhash
from wiresift.llm.common import table
from wiresift.llm.queries import word_tokenizer
from wiresift.session import checkpoint_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base tests nor the learned rules reject."""
    rules = quality.learn_from(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, rules).where("kept").select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier one has; those that lose all they had go."""
    deduped = line_dedup.dedup_lines(docs.select(*COLUMNS))
    left = (F.col("n_dropped") == 0) | (F.length(F.trim(F.col("text"), F.lit(" \t\n\r\x0b\x0c"))) > 0)
    return deduped.where(left).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near-duplicates: 5-word shingles, resemblance 0.8 and more."""
    return wide_simhash.keep_one(docs.select(*COLUMNS))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's tokens lie in the training sequences."""
    return packing.pack(docs, word_tokenizer())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", without_repeated_lines),
    ("simhash near-dedup", without_near_duplicates),
    ("best-fit packing", packed_sequences),
]

#: The rules are learned and the ids come from a tokenizer: SQL can express neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
