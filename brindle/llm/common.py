"""Helpers that the operators share: tables, the shared folder, packed arrays."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that go to a Python worker at once; texts average a few KB, so a batch is a few MB.
ROWS_PER_BATCH = "1000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df, dealt to all cores if its files are too few for them: texts cost much work a row. A large table has files enough and is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def as_row(df: DataFrame, columns: Iterable[str] | None = None) -> Column:
    """Columns of df as one struct `row`, in which Arrow carries any names, those with dots too."""
    return F.struct(*(df[f"`{c}`"] for c in (df.columns if columns is None else columns))).alias("row")


def of_row(columns: Iterable[str]) -> list[Column]:
    """The columns of as_row() again."""
    return [F.col(f"row.`{c}`").alias(c) for c in columns]


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_BATCH)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset, one of our own in local mode; on a cluster that is an error."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = os.path.join(tempfile.gettempdir(), "brindle-shared")
        spark.conf.set("spark.checkpoint.dir", top)
    return top.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder; the JVM deletes it when it ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """While a table is written, Spark deletes the shuffle files of the job when it ends: what follows reads the table."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(spark: SparkSession, df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """df as a table in the shared folder: what follows reads the files, so a lost executor costs no recomputation."""
    with tidy(spark):
        df.write.option("compression", codec).parquet(path := new_path(spark, tag))
    out = spark.read.schema(df.schema).parquet(path)
    out._brindle_path = path
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spent_by(df: DataFrame, source: DataFrame | None = None, *tables: DataFrame) -> DataFrame:
    """df, marked with the tables that nobody needs once it is written; those that source is marked with are taken over."""
    df._brindle_spent = [*getattr(source, "_brindle_spent", []), *(t._brindle_path for t in tables)]
    return df


def drop_spent(df: DataFrame) -> None:
    for path in getattr(df, "_brindle_spent", []):
        drop_path(df.sparkSession, path)


#: Bytes of text whose share of a corpus-wide table is a bucket, which a task holds whole: at least, at most; between them
#: it grows with the root of the input, so that messages between chunks and buckets don't grow with its square.
BUCKET, LARGEST_BUCKET = 8 << 20, 64 << 20


def sized(docs: DataFrame) -> tuple[int, int]:
    """Bytes of all texts, and how many buckets they ask for: at least spark.sql.shuffle.partitions."""
    n = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    size = min(LARGEST_BUCKET, max(BUCKET, int(BUCKET * (n / (64 * BUCKET)) ** 0.5)))
    return n, max(shuffle_partitions(docs.sparkSession), -(-n // size))


def pack(a: np.ndarray, delta: bool = False, level: int = 1) -> bytes:
    """An integer array as bytes: differences if sorted, byte planes, zstd."""
    a = np.ascontiguousarray(a)
    if delta and len(a):
        a = np.concatenate((a[:1], a[1:] - a[:-1]))
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T
    return a.dtype.str.encode().ljust(4) + bytes([delta]) + len(a).to_bytes(8, "little") + zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(planes).tobytes())


def unpack(b: bytes) -> np.ndarray:
    kind, delta, n = np.dtype(b[:4].decode().strip()), b[4], int.from_bytes(b[5:13], "little")
    raw = zstandard.ZstdDecompressor().decompress(b[13:], max_output_size=max(1, n * kind.itemsize))
    a = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T).reshape(-1).view(kind)
    return np.cumsum(a, dtype=kind) if delta else a


def texts(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """The strings of an Arrow column, null as empty."""
    return [t or "" for t in column.to_pylist()]


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until they have size bytes."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
