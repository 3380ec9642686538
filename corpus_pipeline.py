"""Corpus preparation: toxic documents go, one row of each group of near duplicates stays, rows with benchmark
passages go, personal data are masked, and what is left is packed into training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All but the last return the
columns of documents, also further ones of any name; masking sets n_chars anew. The last gives a row for each packed piece.

A document goes as toxic at a score of 0.5 or more, as contaminated if it holds one window of 8 words of a benchmark item,
or windows of two items. Null and empty texts are neither, are copies of each other, and pack into a piece of 0 tokens. Of
near duplicates and repeated rows the one with the smallest doc_id stays (one of them, if that repeats; a null doc_id
only if there is no other). Texts of any length are read whole. Empty tables give no rows; without labels nothing is toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parsimony.llm import decontaminate, minhash, packing, pii, toxicity
from parsimony.llm.common import stored


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_texts(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", remove_contaminated),
    ("personal_data", mask_personal_data),
    ("packing", pack_sequences),
]

#: Nearest neighbours, sampling and packing have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
