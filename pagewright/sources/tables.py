"""Tables of conversations, single-page documents and web pages as documents with pages and sections."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def file_signature(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of the files below a path: another one when data change, without reading them."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(where, True)
    told = []
    while found.hasNext():
        f = found.next()
        told.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(told)).encode()).hexdigest()


def conversation_pages(conversations: DataFrame) -> DataFrame:
    """(doc_id, page_number, text): conversations as documents, turns as their pages."""
    return conversations.select(F.col("conv_id").cast("string").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_number"), F.coalesce("text", F.lit("")).alias("text"))


def document_pages(documents: DataFrame) -> DataFrame:
    """(doc_id, page_number, text): documents of one page."""
    return documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(1).alias("page_number"), F.coalesce("text", F.lit("")).alias("text"))


def whole_sections(pages: DataFrame) -> DataFrame:
    """One section over all pages of each document."""
    rows = pages.groupBy("doc_id").agg(F.min("page_number").alias("page_start"), F.max("page_number").alias("page_end"))
    return rows.select("doc_id", F.lit(0).alias("ord"), F.lit("full-document").alias("section_id"), F.lit("Document Content").alias("title"), F.lit(1).alias("level"), "page_start", "page_end", F.lit(None).cast("string").alias("parent_id"))


def benchmark_queries(benchmark: DataFrame) -> DataFrame:
    """(query_id, query)."""
    return benchmark.select(F.col("item_id").cast("long").alias("query_id"), F.col("text").alias("query"))
