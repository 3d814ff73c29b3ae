"""Sinks: published tables in versions, snapshots that read falls back on, and tables that a job needs for itself."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("articles", "sources", "clusters", "embeddings", "summaries", "trust_dashboard", "trust_fields", "neighbors", "feed", "story_groups")


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _path(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    at, fs = _path(spark, path)
    fs.delete(at, True)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions of a table (those with a commit mark), in order."""
    at, fs = _path(spark, path)
    if not fs.exists(at):
        return []
    found = sorted(int(s.getPath().getName()[2:]) for s in fs.listStatus(at) if s.getPath().getName().startswith("v="))
    return [v for v in found if exists(spark, f"{path}/v={v}/_SUCCESS")]


def current(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The last complete version of a table, or the last before a number."""
    found = [v for v in versions(spark, path) if before is None or v < before]
    return spark.read.parquet(f"{path}/v={found[-1]}") if found else None


def write_version(df: DataFrame, path: str, n: int, keep: int = 2, by: str | None = None, key: str | None = None) -> None:
    """Writes version n, which readers see when its commit mark stands, and deletes all but the last versions.

    With a key, files hold ranges of it in order, with Bloom filters, so that a look for some keys skips most of them (see known())."""
    spark = df.sparkSession
    if key:
        df = df.repartitionByRange(*([by] if by else []), key).sortWithinPartitions(*([by] if by else []), key)
    writer = df.write.mode("overwrite")
    if key:
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
    (writer.partitionBy(by) if by else writer).parquet(f"{path}/v={n}")
    for old in versions(spark, path)[:-keep]:
        remove(spark, f"{path}/v={old}")


#: Keys that are looked up by name; more are joined.
LOOKUPS = 1000


def known(keys: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """The rows of a table whose key is among those of keys(key).

    Some LOOKUPS keys or fewer go into the scan, where ranges and Bloom filters of the files decide what is read at all; more
    are joined. The keys are counted first, so what passes through the driver is bounded."""
    few = [r[0] for r in keys.select(key).where(F.col(key).isNotNull()).distinct().limit(LOOKUPS + 1).collect()]
    if len(few) <= LOOKUPS:
        return table.where(F.col(key).isin(few)) if few else table.limit(0)
    return table.join(keys.select(key).distinct(), key, "left_semi")


def publish(tables: dict[str, DataFrame], root: str, by_day: str | None = None) -> None:
    """Writes a new version of each table to root; by_day names a time column that partitions the tables that have it."""
    for name, df in tables.items():
        if name not in TABLES:
            raise ValueError(f"{name} is no published table")
        path, day = f"{root}/{name}", by_day is not None and by_day in df.columns
        write_version(df.withColumn("day", F.to_date(by_day)) if day else df, path, max([0, *versions(df.sparkSession, path)]) + 1, by="day" if day else None)


def snapshot(spark: SparkSession, *paths: str) -> DataFrame | None:
    """The last version of the first of the tables that exists; a table that can't be read counts as missing."""
    for path in paths:
        df = current(spark, path)
        if df is None and exists(spark, path) and not versions(spark, path):
            try:
                df = spark.read.parquet(path)
            except Exception:  # noqa: BLE001, S112; whatever is wrong with it, the next one is tried
                continue
        if df is not None:
            return df
    return None


def json_or_none(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """Rows of a JSON file; None if there is no such file or a row doesn't parse."""
    if not exists(spark, path):
        return None
    rows = scratch(spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path, multiLine=True), "json")  # parsed once
    if rows.where("_corrupt_record is not null").isEmpty():
        return rows.drop("_corrupt_record")
    unscratch(rows)
    return None


def json_rows(body: Column, schema: str) -> Column:
    """The rows of a landed JSON text, a list or one object; null if it is missing or doesn't parse."""
    fields = f"array<struct<{','.join(f.strip().replace(' ', ':', 1) for f in schema.split(','))}>>"
    return F.when(F.try_parse_json(body).isNotNull(), F.from_json(body, fields))


def cache_write(items: DataFrame, path: str, fetched_at: int) -> bool:
    """Caches items as the version of a time in milliseconds; whether that worked: a cache that can't be written is no error."""
    try:
        write_version(items.withColumn("fetched_at_ms", F.lit(fetched_at)), path, fetched_at)
    except Exception:  # noqa: BLE001; the caller goes on without a cache
        return False
    return True


def cache_read(spark: SparkSession, path: str, now: int, ttl: int | None) -> DataFrame | None:
    """The last cached items if they are younger than ttl milliseconds, or however old they are."""
    last = versions(spark, path)[-1:]
    return current(spark, path) if last and (ttl is None or now - last[0] < ttl) else None


def flushed(items: DataFrame, key: str, make, path: str, parts: int) -> DataFrame:
    """make(items) in `parts` portions, each written when it is done; portions of a run that was broken off are not made again.

    The items are read once: dealt by their key into a folder for each portion, which a run that goes on finds there, and which
    goes when all portions are done.
    """
    spark = items.sparkSession
    todo = [k for k in range(parts) if not exists(spark, f"{path}/part={k}/_SUCCESS")]
    if todo and not exists(spark, f"{path}/_dealt/_SUCCESS"):
        dealt = items.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts)))
        dealt.hint("rebalance", "_part").write.mode("overwrite").partitionBy("_part").parquet(f"{path}/_dealt")
    for k in todo:
        one = f"{path}/_dealt/_part={k}"
        rows = spark.read.schema(items.schema).parquet(one) if exists(spark, one) else items.sparkSession.createDataFrame([], items.schema)  # no item fell to it
        make(rows).write.mode("overwrite").parquet(f"{path}/part={k}")
    remove(spark, f"{path}/_dealt")
    return spark.read.option("basePath", path).parquet(*(f"{path}/part={k}" for k in range(parts))).drop("part")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the folder that the driver and all executors share, spark.checkpoint.dir; in local mode one of our own where that is unset. The JVM deletes it when it ends."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = os.path.join(tempfile.gettempdir(), "brindle-shared")
    path = f"{top.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    at, fs = _path(spark, path)
    fs.deleteOnExit(at)
    return path


def scratch(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder."""
    df.write.parquet(path := scratch_path(df.sparkSession, tag))
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._brindle_path = path
    return out


def unscratch(df: DataFrame) -> None:
    """Drops a table of scratch() that nobody reads any more."""
    remove(df.sparkSession, df._brindle_path)


def embedding_table(items: DataFrame, model: str) -> DataFrame:
    return items.where(F.size("embedding") > 0).select("id", "embedding", F.lit(model).alias("model"))


def exported(state: DataFrame) -> DataFrame:
    """User state as one JSON text a row."""
    return state.select(F.to_json(F.struct("*")).alias("json"))
