"""Bounded samples of labelled rows for fitting a model on the driver; how likely a row is to be taken depends on its class alone.

Which rows are taken is decided on hashes and ids; only then are the texts of the chosen ones fetched, by a broadcast of their ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of all classes together that reach the driver at most. With very many classes each gets a smaller share, but every class is learned.
MOST = 100_000


def _chosen(rows: DataFrame, label: str, key: str, per_class: int, spare: float) -> DataFrame:
    """(label, key, ...) for at most spare * per_class different keys of each label: those with the smallest hash. Counts are of different keys, so rows that repeat
    one, however many, are one row here."""
    counts = rows.groupBy(label).agg(F.approx_count_distinct(key).alias("n")).collect()
    if not counts:
        return rows.limit(0)
    each = max(1, min(int(spare * per_class), MOST // len(counts)))
    # twice what is wanted, as counts are estimates; the exact number is taken behind it
    share = F.create_map(*(x for r in counts for x in (F.lit(r[0]), F.lit(min(1.0, 2 * each / max(1, r["n"]))))))
    few = rows.filter(_place(key) <= share[F.col(label)] * (1 << 30)).groupBy(label, key).agg(F.count("*").alias("n"), *(F.min(c).alias(c) for c in rows.columns if c not in (label, key)))
    order = Window.partitionBy(label).orderBy(_place(key), key)
    return few.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= each).drop("place", "n")


def _place(key: str) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30))


def sample(rows: DataFrame, label: str, per_class: int, spare: float = 1.2) -> list:
    """About per_class different texts (text, label) for each value of label in rows(doc_id, text, label), in order: those whose hash of the text is small, so a
    rerun gives the same rows. A text counts once for a label, however often it is repeated.

    At most spare * per_class rows of a class, and MOST in all, reach the driver. Rows without an id, a text or a label are not taken.
    """
    rows = rows.filter(F.col(label).isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), label)
    hashed = rows.select("doc_id", label, F.xxhash64("text").alias("h"))
    chosen = _chosen(hashed, label, "h", per_class, spare).select("doc_id", label, "h").collect()
    if not chosen:
        return []
    ids = rows.sparkSession.createDataFrame(chosen, hashed.select("doc_id", label, "h").schema)
    taken = rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(ids), ["doc_id", label, "h"]).groupBy(label, "h").agg(F.min("text").alias("text")).select("text", label)
    return sorted((r["text"], r[label]) for r in taken.collect())


def sample_labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int, spare: float = 1.2) -> list:
    """The same for labels that stand in a table of their own, labels(doc_id, label): rows are chosen there, by a hash of doc_id.

    The chosen ids (bounded as above) are broadcast to the documents, so no text is shuffled. A doc_id with several labels gives a row for each; of several
    texts with one doc_id the one with the smallest hash is taken.
    """
    labels = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), label)
    chosen = _chosen(labels, label, "doc_id", per_class, spare).select("doc_id", label).collect()
    if not chosen:
        return []
    ids = docs.sparkSession.createDataFrame(chosen, labels.schema)
    rows = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    taken = rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id", label).agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("t.text", label)
    return sorted((r["text"], r[label]) for r in taken.collect())
