"""Row filters."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tags import any_of, bound, haystack
from ..functions.text import trim
from ..functions.values import BLOCKED_TERMS


def recent(df: DataFrame, ts: str, now: str, days: int = 7) -> DataFrame:
    """Rows of the last days before now, a literal time: a scan can push it down."""
    return df.where(F.col(ts) >= F.lit(now).cast(df.schema[ts].dataType) - F.expr(f"INTERVAL {days} DAYS"))


def newest(df: DataFrame, ts: str, seq: str, most: int = 1000) -> DataFrame:
    return df.orderBy(F.desc(ts), F.asc(seq)).limit(most)


def unblocked(df: DataFrame, title: Column, summary: Column, terms: tuple[str, ...] = BLOCKED_TERMS) -> DataFrame:
    """Rows in whose title and summary no term is a substring."""
    return df.where(~bound(haystack(title, summary), lambda text: any_of(text, tuple(t.lower() for t in terms))))


def two_tier(df: DataFrame, has_url: Column, matched: Column, likes: Column, reposts: Column, topics: bool, enough: int = 12) -> DataFrame:
    """Posts with a link or a topic if they are enough or no topics are asked for; else also those that anyone liked or reposted."""
    marked = df.withColumn("_strict", has_url | matched).withColumn("_relaxed", has_url | (likes > 0) | (reposts > 0))
    n = marked.agg(F.count_if("_strict").alias("_n"))
    use_strict = ((F.col("_n") >= enough) | F.lit(not topics)) & (F.col("_n") > 0)
    return marked.join(F.broadcast(n)).where(F.when(use_strict, F.col("_strict")).otherwise(F.col("_relaxed"))).drop("_strict", "_relaxed", "_n")


def allowed_sources(df: DataFrame, name: Column, settings: DataFrame) -> DataFrame:
    """Rows whose source isn't switched off in settings(name, enabled); unknown and blank names are allowed, the last setting counts."""
    low = lambda c: F.lower(trim(F.coalesce(c, F.lit(""))))
    off = settings.select(low(F.col("name")).alias("_name"), "enabled").where("_name <> '' and enabled = false").select("_name").distinct()
    return df.join(off, low(name) == F.col("_name"), "left_anti")


def allowed_perspectives(groups: DataFrame, off: list[str]) -> DataFrame:
    """Perspectives of sources that aren't switched off; groups without any go."""
    names = F.array(*map(F.lit, off)).cast("array<string>")
    kept = F.filter("perspectives", lambda p: ~F.array_contains(names, F.lower(trim(F.coalesce(p["source"], F.lit(""))))))
    return groups.withColumn("perspectives", kept).where(F.size("perspectives") > 0)


def with_embedding(df: DataFrame) -> DataFrame:
    return df.where(F.size("embedding") > 0)


def placeholder_image(url: Column, serving: bool = True) -> Column:
    out = url.isNull() | (url == "") | url.contains("placeholder.svg")
    return out | url.contains("/globe.svg") if serving else out


def last_n(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The last n rows of each group."""
    return df.withColumn("_back", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order)))).where(F.col("_back") <= n).drop("_back")
