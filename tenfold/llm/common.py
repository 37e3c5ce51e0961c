"""Pieces that the operators share: sizes, shared folders, Arrow columns as NumPy arrays."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenfold.sources import shared


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def size_of(docs: DataFrame) -> int:
    """Catalyst's size estimate of a plan, for a file scan the bytes of its files; where Catalyst knows none, the bytes of text."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= UNKNOWN:
        size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string"))).cast("long")).first()[0] or 0
    return size


#: Input from which on parts grow, and the estimated bytes of a task's partition.
LARGE, TASK = 64 << 30, 64 << 20
#: An estimate from here on stands for none.
UNKNOWN = 1 << 60


def parts_for(spark: SparkSession, size: int, target: int) -> int:
    """Parts of about `target` estimated bytes each, at least the session's shuffle partitions.

    Beyond LARGE bytes a part grows with the fourth root of the input (at 100 TB six times), so that the
    number of pairs of parts grows more slowly than its square while a part still fits a task.
    """
    target = int(target * max(1.0, size / LARGE) ** 0.25)
    return max(shuffle_partitions(spark), -(-size // target))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, size: int, key: str) -> DataFrame:
    """`df` dealt by `key` into partitions of about TASK bytes where the session's number of partitions is too small for `size` bytes."""
    parts = -(-size // TASK)
    return df.repartition(parts, key) if parts > shuffle_partitions(df.sparkSession) else df


def new_path(spark: SparkSession, what: str) -> str:
    return shared.folder(spark, what)


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows of `df` as a Parquet table in the shared folder: lineage ends here and survives lost executors."""
    path = new_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Tables:
    """Tables written on the way to a result, which go when that is written itself."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, new_path(spark, "work")

    def write(self, df: DataFrame, what: str) -> DataFrame:
        path = f"{self.folder}/{what}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as its bytes (null: none) and the n + 1 offsets between rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes, or one row where that is longer."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(end, n)
        at = end


def text_of(docs: DataFrame) -> DataFrame:
    """The two columns that text operators read; other columns can't clash with theirs."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an array of unsigned integers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x
