"""A folder for tables that a session makes on its way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_temporary: list[tempfile.TemporaryDirectory] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, which all executors share, deleted when the driver's JVM ends; where the setting is missing on a local master (as in tests), below a local folder."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _temporary:
            _temporary.append(tempfile.TemporaryDirectory(prefix="pagewright-"))
        top = f"file://{_temporary[0].name}"
    path = f"{top}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows of df from a table in such a folder: made once, and there for any executor."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
