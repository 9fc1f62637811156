"""Canonical exact digests of documents, in built-in functions only.

A text is made canonical (compatibility normalisation and case folding by the ICU library that Spark ships, white space folded), and a wide digest of
four 64-bit xxhashes is taken. Texts with equal digests are a bucket: each is compared, byte by byte, with the canonical text of the bucket's first
document, and one that differs gets its SHA-256 added, so fingerprints are equal just where canonical texts are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import held, holding, stored


def _icu(name: str, text: Column, flag: bool) -> Column:
    owner, _, method = name.rpartition(".")
    return F.java_method(F.lit(f"com.ibm.icu.{owner}"), F.lit(method), text, F.lit(flag))


def canonical(text: Column) -> Column:
    """NFKC, case folding, NFKC again; runs of white space become one space, none at the ends. Null counts as empty."""
    out = _icu("text.Normalizer.compose", F.coalesce(text, F.lit("")), True)
    out = _icu("text.Normalizer.compose", _icu("lang.UCharacter.foldCase", out, True), True)
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def digest(canon: Column) -> Column:
    """256 bits as hex: xxhashes of the text, each begun with another number."""
    return F.lower(F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(k), canon)), 16, "0") for k in range(1, 5))))


def _packed(hexed: Column) -> Column:
    """Half the bytes for what is shuffled."""
    return F.unhex(hexed)


def _shown(packed: Column) -> Column:
    return F.lower(F.hex(packed))


def _named(d: Column, sha: Column, first_sha: Column, same: Column) -> Column:
    """The digest; with the text's own SHA-256 if the bucket's first text is another one."""
    return F.when(first_sha.isNull() | ((sha == first_sha) & same), _shown(d)).otherwise(F.concat(_shown(d), F.lit("-"), _shown(sha)))


def followers(ids: DataFrame) -> DataFrame:
    """For each id of ids(id, first): the next smaller id and its value of first; the largest one's for the smallest id.

    Ids are dealt to ranges; each range finds the followers within it, and the heads of the ranges (as many as there are partitions) give the rest.
    """
    ranges = stored(ids.repartitionByRange(F.col("id").desc()).withColumn("range", F.spark_partition_id()))
    inside = Window.partitionBy("range").orderBy(F.col("id").desc())
    rows = ranges.withColumn("next", F.lead(F.struct("id", "first")).over(inside))
    heads = ranges.groupBy("range").agg(F.max(F.struct("id", "first")).alias("head"))
    after = heads.select("range", F.coalesce(F.lead("head").over(Window.orderBy("range")), F.max("head").over(Window.partitionBy())).alias("head"))
    return holding(rows.join(after, "range").select("id", F.coalesce("next", "head").alias("next")).select("id", F.col("next.id").alias("next_id"), F.col("next.first").alias("next_first")), ranges)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, fingerprint) for each row of docs(doc_id, text); equal canonical texts, and only these, have equal fingerprints.

    Null texts count as empty. Rows may repeat, and doc_id may repeat or be null. An empty table gives no rows.
    """
    docs = _typed(docs)
    signed, buckets = _buckets(docs)
    return holding(_confirmed(docs, signed, buckets).select("doc_id", _shown(F.col("digest")).alias("digest"), "fingerprint"), signed)


def _buckets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    canon = docs.withColumn("canon", canonical(F.col("text")))
    signed = stored(canon.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), _packed(digest(F.col("canon"))).alias("digest"), _packed(F.sha2("canon", 256)).alias("sha")))
    first = signed.groupBy("digest").agg(F.min(F.struct("doc_id", "sha")).alias("first"), F.count("*").alias("n"))
    return signed, first.select("digest", F.col("first.doc_id").alias("first_id"), F.col("first.sha").alias("first_sha"), "n")


def _typed(docs: DataFrame) -> DataFrame:
    """doc_id and text; columns of the right type stay as they are, since an alias would keep exchanges of them from being told the same."""
    kinds = dict(docs.dtypes)
    return docs.select(*(c if kinds[c] == k else F.col(c).cast(k).alias(c) for c, k in (("doc_id", "bigint"), ("text", "string"))))


def _texts(docs: DataFrame) -> DataFrame:
    """The rows with an id."""
    return docs.filter("doc_id IS NOT NULL").select("doc_id", "text")


def _confirmed(docs: DataFrame, signed: DataFrame, buckets: DataFrame) -> DataFrame:
    """signed with fingerprint: members of buckets with several documents are compared with the first one's text."""
    several = buckets.filter("n > 1 AND first_id IS NOT NULL").select("digest", "first_id")
    marked = signed.join(several, "digest").filter("doc_id <> first_id").select("doc_id", "digest", "first_id", "sha").distinct()
    # texts stand on the same side of each join in the same form, so all joins read one exchange of them
    known = _texts(docs)
    own = known.join(marked, "doc_id").withColumn("canon", canonical(F.col("text"))).filter(_packed(digest(F.col("canon"))) == F.col("digest")).select("doc_id", "sha", "first_id", "canon").alias("own")
    first = _texts(docs).alias("first")
    pairs = first.join(own, F.col("first.doc_id") == F.col("own.first_id")).select("own.doc_id", "own.sha", (F.col("own.canon") == canonical(F.col("first.text"))).alias("same"))
    differ = pairs.groupBy("doc_id", "sha").agg(F.max("same").alias("same")).filter("NOT same")
    out = signed.join(buckets.select("digest", "first_sha"), "digest")
    out = out.join(differ.withColumnRenamed("same", "known_same"), ["doc_id", "sha"], "left")
    return out.withColumn("fingerprint", _named(F.col("digest"), F.col("sha"), F.col("first_sha"), F.coalesce("known_same", F.lit(True)))).drop("known_same")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of docs(doc_id, text).

    The edited text has its last third replaced by the beginning of the next document in descending order of doc_id (the first one's after the last).
    near_* are 1 where the two canonical texts are equal and 0 elsewhere. Rows that repeat a doc_id have the same next document; if that one's doc_id
    repeats, the row with the smallest hash stands for it. Rows without a doc_id come after no other and nothing follows them: what they lose is replaced
    by nothing, and near_next is 0. Null texts count as empty. An empty table gives no rows.
    """
    docs = _typed(docs)
    signed, buckets = _buckets(docs)
    ids = signed.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.min(F.struct("digest", "sha")).alias("first"), F.max(F.expr("n_chars div 3")).alias("part"))
    ids = stored(ids)
    next_ = followers(ids.select("id", "first"))
    after = stored(holding(next_.join(ids.select("id", "part"), "id"), *held(next_)))
    # only the beginning of the next text moves on
    lead = _texts(docs).alias("d").join(after.filter("part > 0").alias("a"), F.col("d.doc_id") == F.col("a.next_id"))
    if _repeats(ids, signed):
        lead = lead.filter(_packed(digest(canonical(F.col("d.text")))) == F.col("a.next_first.digest"))
    lead = lead.select("a.id", F.expr("substring(coalesce(d.text, ''), 1, cast(a.part AS int))").alias("head"))
    lead = lead.groupBy("id").agg(F.first("head").alias("head")).alias("l")
    edited = _texts(docs).alias("d").join(lead, F.col("d.doc_id") == F.col("l.id"), "left").select("d.doc_id", "d.text", "l.head")
    edited = edited.unionByName(docs.filter("doc_id IS NULL").withColumn("head", F.lit("")))
    text = F.coalesce("text", F.lit(""))
    edited = edited.select("doc_id", text.alias("text"), F.concat(F.expr("substring(coalesce(text, ''), 1, length(coalesce(text, '')) - cast(length(coalesce(text, '')) div 3 AS int))"), F.expr("substring(coalesce(head, ''), 1, cast(length(coalesce(text, '')) div 3 AS int))")).alias("edited"))
    edited = edited.withColumn("canon", canonical(F.col("text"))).withColumn("edited_canon", canonical(F.col("edited")))
    edited = edited.select(
        "doc_id",
        _packed(F.sha2("canon", 256)).alias("sha"),
        _packed(F.sha2("edited", 256)).alias("edited_sha256"),
        _packed(digest(F.col("edited_canon"))).alias("edited_digest"),
        _packed(F.sha2("edited_canon", 256)).alias("edited_sha"),
        (F.col("canon") == F.col("edited_canon")).cast("double").alias("near_edited"),
    )
    named = _confirmed(docs, signed, buckets).groupBy("doc_id", "sha").agg(F.first("n_chars").alias("n_chars"), F.first("digest").alias("digest"), F.first("fingerprint").alias("fingerprint"))
    out = edited.join(named.withColumnRenamed("doc_id", "own"), F.col("doc_id").eqNullSafe(F.col("own")) & (edited.sha == named.sha)).drop(named.sha)
    out = out.join(buckets.select(F.col("digest").alias("edited_digest"), "first_sha"), "edited_digest", "left")
    out = out.join(after.select(F.col("id").alias("doc_id"), "next_first"), "doc_id", "left")
    out = out.select(
        "doc_id",
        "n_chars",
        _shown(F.col("edited_sha256")).alias("edited_sha256"),
        "fingerprint",
        _named(F.col("edited_digest"), F.col("edited_sha"), F.col("first_sha"), F.lit(True)).alias("edited_fingerprint"),
        "near_edited",
        F.coalesce((F.col("digest") == F.col("next_first.digest")) & (F.col("sha") == F.col("next_first.sha")), F.lit(False)).cast("double").alias("near_next"),
    )
    return holding(out, signed, ids, after)


def _repeats(ids: DataFrame, signed: DataFrame) -> bool:
    """Whether some doc_id stands in several rows, so that the row which stands for it must be picked."""
    return ids.count() < signed.filter("doc_id IS NOT NULL").count()
