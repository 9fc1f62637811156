"""The document store: Parquet tables in batches, upserts, look-ups, question files, sinks."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import extract
from . import scratch

TABLES = ["doc_meta", "pages", "sections", "links", "forms", "attachments"]


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def corpus_signature(documents: DataFrame) -> DataFrame:
    """One row: SHA-256 over the sorted (doc_id, content_hash) pairs of documents. The digest is sequential, so one task reads the sorted pairs, a batch at a time."""
    import hashlib

    import pyarrow as pa

    def digest(batches):
        h = hashlib.sha256()
        for batch in batches:
            for pair in batch.column("pair").to_pylist():
                h.update(pair.encode())
        yield pa.RecordBatch.from_arrays([pa.array([h.hexdigest()])], ["signature"])

    pairs = documents.select("doc_id", "content_hash", F.concat("doc_id", F.lit("\0"), "content_hash", F.lit("\0")).alias("pair"))
    return pairs.repartition(1).sortWithinPartitions("doc_id", "content_hash").select("pair").mapInArrow(digest, "signature string")


def latest(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("n = 1").drop("n")


def merged(disk: DataFrame, memory: DataFrame, key: str = "doc_id") -> DataFrame:
    """All documents of both; where both have one, memory's."""
    both = disk.withColumn("precedence", F.lit(1)).unionByName(memory.withColumn("precedence", F.lit(0)))
    return latest(both, key, F.col("precedence")).drop("precedence")


class Store:
    """Tables under a folder, written batch by batch.

    A batch holds whole documents, and counts once its doc_meta, which is written last, is complete. The last version of a doc_id counts, and the last document
    of a content hash; among those of one batch the one with the smallest hash, or id. Rows that no longer count stay in their files until compact().
    Every row has a doc_id and a content_hash. There is one writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or spark.conf.get("spark.pagewright.store.dir", None) or os.environ.get("PAGEWRIGHT_STORE_DIR") or f"{spark.conf.get('spark.sql.warehouse.dir')}/pagewright"

    def save(self, tables: dict[str, DataFrame]) -> None:
        """Writes doc_meta and other tables of documents; they replace what was saved of the same documents before."""
        if "doc_meta" not in tables:
            raise ValueError("a batch needs the table doc_meta")
        batch = self._next()
        for name in sorted(tables, key="doc_meta".__eq__):
            self._write(tables[name], name, batch)

    def read(self, name: str) -> DataFrame:
        """The rows of a table that count. What no longer counts is left out by a join with the versions that were replaced, which are few after compact()."""
        rows = self._files(name)
        if rows is None:
            raise LookupError(f"the store has no table {name!r}")
        gone = self._versions().filter("NOT counts").select("doc_id", "content_hash", "batch")
        return rows.join(gone, ["doc_id", "content_hash", "batch"], "left_anti").select([c for c in rows.columns if c != "batch"])

    def load_by_hash(self, digest: str) -> dict[str, DataFrame]:
        """The tables of one document; files without its hash are passed over by their statistics and Bloom filters."""
        return {t: self.read(t).filter(F.col("content_hash") == digest) for t in TABLES if self._there(t)}

    def get(self, id_or_hash: str) -> DataFrame:
        """The metadata row of a document, by id or by content hash."""
        return self.read("doc_meta").filter((F.col("doc_id") == id_or_hash) | (F.col("content_hash") == id_or_hash)).orderBy("doc_id").limit(1)

    def list_documents(self) -> DataFrame:
        """Metadata only, by id."""
        return self.read("doc_meta").orderBy("doc_id")

    def remove_by_hash(self, digest: str) -> bool:
        """Removes the document with a hash until it is saved again; whether there was one."""
        if not self._there("doc_meta") or self.read("doc_meta").filter(F.col("content_hash") == digest).isEmpty():
            return False
        self._write(self.spark.range(1).select(F.lit(digest).alias("content_hash")), "removed", self._next())
        return True

    def compact(self) -> None:
        """Writes the rows that count as one batch and deletes the files of all earlier ones; tables read before must be read again."""
        old, batch = self._batches("doc_meta"), self._next()
        for name in [*(t for t in TABLES if t != "doc_meta" and self._there(t)), "doc_meta"]:
            self._write(self.read(name), name, batch)
        for name in [*reversed(TABLES), "removed"]:
            for b in self._batches(name):
                if b < batch and (b in old or name == "removed"):
                    self._delete(f"{name}/batch={b}")

    def _write(self, rows: DataFrame, name: str, batch: int) -> None:
        sorted_rows = rows.sortWithinPartitions("content_hash").write.mode("overwrite").option("parquet.bloom.filter.enabled#content_hash", "true")
        sorted_rows.parquet(f"{self.folder}/{name}/batch={batch}")

    def _files(self, name: str) -> DataFrame | None:
        """All rows of complete batches, with their batch; None without any."""
        done = set(self._batches("removed" if name == "removed" else "doc_meta"))
        paths = [f"{self.folder}/{name}/batch={b}" for b in self._batches(name) if b in done]
        return self.spark.read.option("basePath", f"{self.folder}/{name}").parquet(*paths) if paths else None

    def _versions(self) -> DataFrame:
        """(doc_id, content_hash, batch, counts) of all documents of all batches."""
        rows = self._files("doc_meta").select("doc_id", "content_hash", "batch").distinct()
        last = lambda key, then: F.row_number().over(Window.partitionBy(key).orderBy(F.col("batch").desc(), then)) == 1
        rows = rows.withColumn("counts", last("doc_id", "content_hash")).withColumn("counts", F.col("counts") & last("content_hash", "doc_id"))
        removed = self._files("removed")
        if removed is None:
            return rows
        until = removed.groupBy("content_hash").agg(F.max("batch").alias("until"))
        return rows.join(until, "content_hash", "left").withColumn("counts", F.col("counts") & (F.coalesce("until", F.lit(-1)) < F.col("batch"))).drop("until")

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _batches(self, name: str) -> list[int]:
        """The numbers of a table's complete batches."""
        path, fs = self._path(name)
        if not fs.exists(path):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(path)]
        return sorted(int(n[6:]) for n in names if n.startswith("batch=") and fs.exists(self._path(f"{name}/{n}/_SUCCESS")[0]))

    def _next(self) -> int:
        return max([*self._batches("doc_meta"), *self._batches("removed")], default=-1) + 1

    def _there(self, name: str) -> bool:
        return bool(set(self._batches(name)) & set(self._batches("doc_meta")))

    def _delete(self, name: str) -> None:
        path, fs = self._path(name)
        fs.delete(path, True)


QUESTIONS = "id string, query string, domain string, expected_concepts array<string>, target_tool string, evaluation_criteria struct<requires_provenance:boolean,max_context_tokens:int>"
LABELLED = "description string, answerable array<struct<document:string,document_title:string,question:string,expected_page_start:int,expected_page_end:int,grounded_in:string,paraphrased:boolean>>, unanswerable array<struct<question:string,why_uncovered:string>>"


def questions(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query, domain, expected_concepts, target_tool, requires_provenance, max_context_tokens) of a JSON array, with defaults for what is missing."""
    rows = spark.read.schema(QUESTIONS).option("multiLine", True).json(path)
    none = F.array().cast("array<string>")
    return rows.select(F.col("id").alias("query_id"), "query", F.coalesce("domain", F.lit("general")).alias("domain"), F.coalesce("expected_concepts", none).alias("expected_concepts"), F.coalesce("target_tool", F.lit("document_get_evidence")).alias("target_tool"), F.coalesce("evaluation_criteria.requires_provenance", F.lit(True)).alias("requires_provenance"), F.coalesce("evaluation_criteria.max_context_tokens", F.lit(1500)).alias("max_context_tokens"))


def labelled_questions(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query, answerable, paraphrased, document_title, page_start, page_end) of a labelled set."""
    rows = spark.read.schema(LABELLED).option("multiLine", True).json(path)
    yes = rows.select(F.posexplode("answerable").alias("n", "q")).select(F.concat(F.lit("a"), "n").alias("query_id"), F.col("q.question").alias("query"), F.lit(True).alias("answerable"), F.coalesce("q.paraphrased", F.lit(False)).alias("paraphrased"), F.col("q.document_title").alias("document_title"), F.col("q.expected_page_start").alias("page_start"), F.col("q.expected_page_end").alias("page_end"))
    no = rows.select(F.posexplode("unanswerable").alias("n", "q")).select(F.concat(F.lit("u"), "n").alias("query_id"), F.col("q.question").alias("query"), F.lit(False).alias("answerable"), F.lit(False).alias("paraphrased"), F.lit(None).cast("string").alias("document_title"), F.lit(None).cast("int").alias("page_start"), F.lit(None).cast("int").alias("page_end"))
    return yes.unionByName(no)


def as_json(rows: DataFrame) -> DataFrame:
    """One column: each row as JSON."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def write_attachments(attachments: DataFrame, folder: str) -> DataFrame:
    """Writes each attachment with a safe name as a file below folder/<doc_id> and returns (doc_id, filename, written); unsafe names are skipped.

    Executors write the files, through Arrow's file systems: the folder is an absolute path or URI that all of them reach. A task that runs again writes its files
    again. Of attachments of one document with the same name, one stays.
    """
    from urllib.parse import quote

    import pyarrow as pa
    from pyarrow import fs

    def write(batches):
        files, top = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for r in batch.select(["doc_id", "safe", "data"]).to_pylist():
                if r["safe"] is not None:
                    own = f"{top}/{quote(r['doc_id'], safe='')}"
                    files.create_dir(own, recursive=True)
                    with files.open_output_stream(f"{own}/{r['safe']}") as out:
                        out.write(bytes(r["data"] or b""))
            written = pa.array([x is not None for x in batch.column("safe").to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("filename"), written], ["doc_id", "filename", "written"])

    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = attachments.select(doc.alias("doc_id"), "filename", extract.safe_name(F.col("filename")).alias("safe"), "data")
    return scratch.kept(rows.mapInArrow(write, "doc_id string, filename string, written boolean"), "attachments")
