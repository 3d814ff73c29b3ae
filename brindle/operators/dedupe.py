"""Dedupe operators. seq is the explicit arrival order; it breaks every tie."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse
from ..sources.sinks import scratch, unscratch


def latest(df: DataFrame, key: Column, ts: Column, seq: Column) -> DataFrame:
    """The newest row of each key; of equal times the first. slot is the key's first arrival, which orders equal times."""
    one = Window.partitionBy("_key")
    rows = df.withColumn("_key", key).withColumn("slot", F.min(seq).over(one)).withColumn("_rank", F.row_number().over(one.orderBy(ts.desc(), seq.asc())))
    return rows.where("_rank = 1").drop("_key", "_rank")


def newest_first(df: DataFrame, ts: Column, seq: Column) -> DataFrame:
    return df.orderBy(ts.desc(), seq.asc())


def first_wins(df: DataFrame, key: Column, seq: Column) -> DataFrame:
    rows = df.withColumn("_key", key).withColumn("_rank", F.row_number().over(Window.partitionBy("_key").orderBy(seq.asc())))
    return rows.where("_rank = 1").drop("_key", "_rank")


def first_by_domain(df: DataFrame, group: Column, domain: Column, seq: Column) -> DataFrame:
    """The first row of each domain within a group; rows without a domain go."""
    return first_wins(df.where(domain.isNotNull()), F.struct(group, domain), seq)


def item_key(url: str = "url", post_url: str = "post_url", id: str = "id") -> Column:
    return F.coalesce(F.col(url), F.col(post_url), F.col(id))


def social(df: DataFrame, batch: str, key: Column, text: Column, seq: Column) -> DataFrame:
    """Sequential dedupe: a row goes if an accepted row of its batch has its key or its text, and only accepted rows count.

    Exact in rounds: the first undecided row of its key that is the first of its text too is accepted, and what shares a key or a
    text with it goes. Rows that agree in both go at once, so a hot text is few rows; a round is some aggregates and joins over
    what is left, and a run of rows each of which clashes with the one before takes a round for two of them. seq is any order.
    """
    plain = F.lower(collapse(F.coalesce(text, F.lit(""))))
    named = df.select(F.col(batch).alias("_batch"), seq.alias("_seq"), key.alias("_key"), F.when(plain != "", F.md5(plain)).alias("_text"))
    k, t = F.struct("_batch", "_key").alias("_k"), F.when(F.col("_text").isNotNull(), F.struct("_batch", "_text")).alias("_t")  # nulls within structs are equal
    left = scratch(named.groupBy("_batch", "_key", "_text").agg(F.min("_seq").alias("_seq")).select("_batch", "_seq", k, t), "undecided")
    kept = left.select("_batch", "_seq").limit(0)
    while not left.isEmpty():
        first = left.groupBy("_k").agg(F.min("_seq").alias("_a"))
        of_text = left.where("_t is not null").groupBy("_t").agg(F.min("_seq").alias("_b"))
        rows = left.join(first, "_k").join(of_text, "_t", "left")
        won = scratch(rows.where("_seq = _a and (_b is null or _seq = _b)").select("_batch", "_seq", "_k", "_t"), "accepted")
        before, left = left, scratch(left.join(won.select("_k").distinct(), "_k", "left_anti").join(won.where("_t is not null").select("_t").distinct(), "_t", "left_anti").select(*left.columns), "undecided")
        kept = kept.unionByName(won.select("_batch", "_seq"))
        unscratch(before)
    return df.join(kept, F.col(batch).eqNullSafe(F.col("_batch")) & (seq == F.col("_seq")), "left_semi")
