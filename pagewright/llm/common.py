"""What several training-data operators share: tables written to the shared folder, Arrow batches in bounded pieces, and 64-bit hashes over bytes in numpy."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that are worked on at once; a longer text is a piece of its own.
PIECE_BYTES = 1 << 18
#: A key with more than this part of a table's rows is hot; at most so many keys can be.
HOT = 2000
_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}
_temporary: list[tempfile.TemporaryDirectory] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where the setting is missing on a local master (as in tests), a new local folder, which is then set for the session."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        _temporary.append(tempfile.TemporaryDirectory(prefix="pagewright-"))
        folder = f"file://{_temporary[-1].name}"
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def stored(df: DataFrame) -> DataFrame:
    """The rows of df from a Parquet table in the shared folder: cuts the lineage and survives lost executors. The table goes with released(), or else when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/pagewright-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    released(*held(df))
    out = spark.read.schema(df.schema).parquet(path)
    out._pagewright_path = path
    where, files = _file_system(spark, path)
    files.deleteOnExit(where)
    return out


def released(*tables: DataFrame) -> None:
    """Deletes tables made by stored() that nothing reads any more."""
    for t in tables:
        where, files = _file_system(t.sparkSession, t._pagewright_path)
        files.delete(where, True)


def holding(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """df, which reads tables made by stored(); they go when df itself has been stored."""
    df._pagewright_holds = (*held(df), *tables)
    return df


def held(df: DataFrame) -> tuple[DataFrame, ...]:
    """What df reads by holding(): for another DataFrame that is made of df."""
    return getattr(df, "_pagewright_holds", ())


def unused(name: str, *tables: DataFrame) -> str:
    """A column name that none of the tables has, whatever the case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def hot_join(left: DataFrame, right: DataFrame, on: list[str], count: str, rows: int, how: str = "inner") -> DataFrame:
    """left joined (inner or left_semi) with right, which has one row for each key and, in its column count, how many rows of left bear it; count doesn't come out.

    Keys with more than 1/HOT of the rows of left, at most HOT by that, are broadcast, so their rows stay where they are; the others meet by key.
    """
    limit = max(1, rows // HOT)
    hot, rest = right.filter(F.col(count) > limit).drop(count), right.filter(F.col(count) <= limit).drop(count)
    if hot.isEmpty():
        return left.join(rest, on, how)
    return left.join(F.broadcast(hot), on, how).unionByName(left.join(F.broadcast(hot.select(on)), on, "left_anti").join(rest, on, how))


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def text_pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them) for runs of rows (strings or binary) with at most limit bytes, or one longer row. A null text counts as empty."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words under which every bit depends on all bits."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers (at least) of the base, or of its inverse modulo 2**64."""
    have = _powers.get(inverse)
    if have is None or len(have) < n:
        base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
        size = max(n, 2 * PIECE_BYTES)
        have = np.full(size, base, U64)
        have[0] = 1
        have = np.cumprod(have, dtype=U64)
        if n <= 4 * PIECE_BYTES:  # what very long texts need isn't kept
            _powers[inverse] = have
    return have


class ByteHashes:
    """Hashes of any substrings of some bytes: equal bytes have equal hashes wherever they stand."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.empty(n + 1, U64)
        self.sums[0] = 0
        np.cumsum((data.astype(U64) + U64(1)) * powers(n + 1)[:n], out=self.sums[1:])
        self.inverse = powers(n + 1, inverse=True)

    def of(self, starts, ends) -> np.ndarray:
        """For index arrays, or for slices of equal length."""
        at = self.inverse[starts] if not isinstance(starts, slice) else self.inverse[starts]
        return (self.sums[ends] - self.sums[starts]) * at


def binary(values: list[bytes | None]) -> pa.Array:
    return pa.array(values, pa.binary())


def lists(values: np.ndarray) -> pa.Array:
    """A list column from the rows of a matrix."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.array(values.reshape(-1)))


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches in which rows with equal keys stand together; groups are gathered several to a table where small."""
    waiting: list[pa.RecordBatch] = []

    def change(batch: pa.RecordBatch) -> int:
        """Where the last group of the batch begins."""
        at = 0
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            diff = np.flatnonzero(v[1:] != v[:-1])
            at = max(at, int(diff[-1]) + 1 if len(diff) else 0)
        return at

    def same(a: pa.RecordBatch, b: pa.RecordBatch) -> bool:
        return all(a.column(k)[len(a) - 1].as_py() == b.column(k)[0].as_py() for k in keys)

    for batch in batches:
        if not len(batch):
            continue
        if waiting and not same(waiting[-1], batch):
            yield pa.Table.from_batches(waiting)
            waiting = []
        at = change(batch)
        if at:
            yield pa.Table.from_batches([*waiting, batch.slice(0, at)])
            waiting = []
        waiting.append(batch.slice(at))
    if waiting:
        yield pa.Table.from_batches(waiting)
