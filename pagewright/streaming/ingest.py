"""An extension beside batch ingestion: new PDF files of a folder are parsed as they come and put into the store."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources import pdf
from ..sources.store import Store


def ingest_stream(spark: SparkSession, folder: str, store: Store, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Watches a folder; each micro-batch is upserted by document, so a batch that runs twice changes nothing."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", True).load(folder)

    def upsert(batch, _: int) -> None:
        rows = pdf.parsed(batch).persist()
        tables = pdf.tables(rows)
        tables.pop("errors")
        store.save(tables)
        rows.unpersist()

    writer = files.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
