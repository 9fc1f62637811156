"""The training-data pipeline: toxic documents go, one document of each near-duplicate group stays, long repeated passages are cut, documents with benchmark
items go, and what is left is encoded and decoded by byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next stage's docs.

All stages read doc_id and text; other columns go along, whatever their names. Null texts stay null and count as empty. Empty and very long texts are texts
like others. Rows without a doc_id are documents of their own. An empty table gives an empty one with the same columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm import bpe, decontaminate, minhash, suffix_dedup, toxicity
from pagewright.llm.common import held, holding, stored, unused

#: Bytes of a repeated passage. Few stretches of more than fifty words are shorter (README); where such ones repeat, they stay.
REPEATED_BYTES = suffix_dedup.PASSAGE


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic; the model is fitted on the labelled ones among docs. Without labels for both sides all stay.

    Null and empty texts have no features and stay. Rows that repeat are judged each by itself."""
    return toxicity.without_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest doc_id. Rows without a doc_id, and null and empty texts, are linked with nothing and stay.

    Rows that repeat a doc_id are one document with several texts: each of its different texts stays once, with the smallest values of the other columns."""
    groups = minhash.near_duplicates(docs)
    kept = groups.filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    n = unused("n", docs)
    first = Window.partitionBy("doc_id", "text").orderBy(*(c for c in docs.columns if c not in ("doc_id", "text")), F.lit(0))
    own = docs.join(kept, "doc_id", "left_semi").withColumn(n, F.row_number().over(first)).filter(F.col(n) == 1).select(docs.columns)
    return holding(own.unionByName(docs.filter("doc_id IS NULL")), *held(groups))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their bytes in strings of REPEATED_BYTES that start elsewhere too, in the same text or another; n_chars follows the text (null: null).

    Null, empty and short texts lose nothing. Rows that repeat lose what they share, every occurrence."""
    cut = suffix_dedup.cut_texts(docs, REPEATED_BYTES)
    return holding(cut.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast("long")), *held(cut))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without leaked benchmark items. Null and empty texts, and rows without a doc_id, stay; rows that repeat a doc_id go or stay together."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of each row; a null or empty text has no ids."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("byte_bpe", encode),
]

#: Fitted models, MinHash and BPE can't be written in SQL; tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of a folder; what comes before is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        # what a stage has read goes when its result is written
        docs = stored(holding(made, *([docs] if k else []))) if k < len(STAGES) - 1 else holding(made, docs)
    return docs
