"""Stages of an operator whose chunks and buckets exchange packed arrays.

A stage is a table in the shared folder, partitioned by kind, with rows (chunk, kind, bucket, data).
"""

from __future__ import annotations

import contextlib
import ctypes
import struct

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from .common import drop_path, new_path, shuffle_partitions, tidy

ROWS = "chunk long, kind int, bucket int, data binary"
ARROW = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("data", pa.binary())])


def join(*parts: bytes) -> bytes:
    return struct.pack(f"<{len(parts) + 1}q", len(parts), *map(len, parts)) + b"".join(parts)


def split(data: bytes) -> list[bytes]:
    n = struct.unpack_from("<q", data)[0]
    sizes, at, out = struct.unpack_from(f"<{n}q", data, 8), 8 * (n + 1), []
    for s in sizes:
        out.append(data[at : at + s])
        at += s
    return out


def trimmed() -> None:
    """Gives freed memory back to the system: the workers of an executor share its memory."""
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def frame(rows: list[tuple[int, int, int, bytes]]) -> pd.DataFrame:
    trimmed()
    return pd.DataFrame(rows, columns=["chunk", "kind", "bucket", "data"])


def record_batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 4, ARROW, strict=True)], schema=ARROW)


def stage(df: DataFrame, tag: str) -> DataFrame:
    """df written and read again."""
    spark = df.sparkSession
    with tidy(spark):
        df.write.partitionBy("kind").option("compression", "none").parquet(path := new_path(spark, tag))
    out = spark.read.schema(ROWS).parquet(path)
    out._brindle_path = path
    return out


def drop_kind(df: DataFrame, kind: int) -> None:
    """Deletes the rows of a kind, when a later stage has taken them in."""
    drop_path(df.sparkSession, f"{df._brindle_path}/kind={kind}")


def rows_of(df: DataFrame, *kinds: int) -> DataFrame:
    spark = df.sparkSession
    if path := getattr(df, "_brindle_path", None):  # a file listing of its own: other kinds may be deleted
        df = spark.read.schema(ROWS).parquet(path)
    return df.where(F.col("kind").isin(*kinds)).select("chunk", "kind", "bucket", "data")


def grouped(df: DataFrame, key: str, tasks: int) -> GroupedData:
    """df by chunk or bucket, in so many tasks: what a task reads doesn't grow with the input."""
    return df.repartition(max(shuffle_partitions(df.sparkSession), tasks), key).groupBy(key)
