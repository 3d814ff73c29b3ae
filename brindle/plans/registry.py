"""Where queries over the test tables register, with their SQL. Times are literals, never the clock."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NOW = "2024-01-31 00:00:00"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table whose rows cost much work each: dealt to all cores if its files are too few for them."""
    df = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < 2 * cores else df


def values(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A table of literal cases."""
    return spark.createDataFrame(rows, schema)


def sql_values(name: str, columns: str, rows: list[tuple]) -> str:
    """The same cases as a common table expression."""
    return f"{name}({columns}) as (values " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows) + ")"


def _literal(x) -> str:
    if x is None:
        return "null"
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(_literal, x)) + "]"
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    return str(x)
