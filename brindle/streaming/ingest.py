"""Streaming ingest: the latest row of each key in keyed state, and windowed counts with a watermark.

The state lives in Spark's state store (RocksDB, whose checkpoints are logs of changes), so a micro-batch reads and writes the
keys that it brings, however many there are already. What changed is appended to the table as version n of its changes; readers
take the last change of each key. fold() puts the changes into a base from time to time.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.sinks import current, remove, versions, write_version

_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


@contextlib.contextmanager
def _with_store(spark: SparkSession) -> Iterator[None]:
    """Settings that a streaming query takes over when it starts."""
    before = {k: spark.conf.get(k, None) for k in _STORE}
    for k, v in _STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def latest_rows(stream: DataFrame, key: str, ts: str, seq: str) -> DataFrame:
    """The newest row of each key so far; of equal times the one of least seq, whichever micro-batch brought it. Null times are the oldest."""
    newest = F.max_by(F.struct(*(F.col(f"`{c}`") for c in stream.columns)), F.struct(F.col(ts), -F.col(seq)))
    return stream.groupBy(F.col(key).alias("_key")).agg(newest.alias("_row")).select("_row.*")


def upsert_latest(stream: DataFrame, key: str, ts: str, seq: str, table: str, checkpoint: str) -> StreamingQuery:
    """Keeps in the table the newest row of each key, as latest_rows() has it; latest_table() reads it."""
    return changes_to(latest_rows(stream, key, ts, seq), table, checkpoint)


def changes_to(rows: DataFrame, table: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Writes what each micro-batch n of a stateful stream changes as version n of the table's changes. Run again, it overwrites
    that version with the same rows."""

    def append(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/changes/v={n}")

    with _with_store(rows.sparkSession):
        return rows.writeStream.outputMode(mode).foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_table(spark: SparkSession, table: str, *key: str) -> DataFrame | None:
    """The table's rows: of each key the last change, else its row in the base. None if nothing was written yet."""
    base = versions(spark, f"{table}/base")[-1:]
    new = [v for v in versions(spark, f"{table}/changes") if not base or v > base[0]]
    old = current(spark, f"{table}/base")
    if not new:
        return old
    rows = spark.read.option("basePath", f"{table}/changes").parquet(*(f"{table}/changes/v={v}" for v in new)).withColumn("v", F.col("v").cast("long"))
    columns = [c for c in rows.columns if c != "v"]
    if old is not None:
        rows = rows.unionByName(old.withColumn("v", F.lit(-1).cast("long")))
    return rows.groupBy(F.struct(*(F.col(f"`{k}`") for k in key)).alias("_key")).agg(F.max_by(F.struct(*(F.col(f"`{c}`") for c in columns)), "v").alias("_row")).select("_row.*")


def fold(spark: SparkSession, table: str, *key: str) -> None:
    """Writes the table as a base, after which readers need no change up to now. Changes that the base before needs stay until the next fold."""
    new, before = versions(spark, f"{table}/changes"), versions(spark, f"{table}/base")
    if new and (not before or new[-1] > before[-1]):
        write_version(latest_table(spark, table, *key), f"{table}/base", new[-1])
        for v in new:
            if before and v <= before[-1]:
                remove(spark, f"{table}/changes/v={v}")


def windowed_counts(stream: DataFrame, ts: str, group: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts by tumbling window; rows later than the watermark are dropped."""
    rows = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return rows.groupBy(F.window(ts, window), group).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), group, "n")


def distinct_within(stream: DataFrame, ts: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
