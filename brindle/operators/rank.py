"""Rankings and orders of a feed."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tags import _CANONICAL, allowed_tag_scores, any_of, bound, canonical_tag
from ..functions.text import good_bullets, trim
from ..functions.values import BOOSTED_SOURCES
from ..sources.sinks import scratch
from .filters import placeholder_image


def _plain(text: str) -> str:
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in text.lower().replace("&", " and ")).split())


def matchers(topics: list[str]) -> list[tuple[str | None, str]]:
    """(canonical tag in lower case or None, token) of each distinct topic."""
    out: dict[tuple[str | None, str], None] = {}
    for raw in topics:
        canonical = _CANONICAL.get(_plain(raw or ""))
        if token := _plain(canonical or raw or ""):
            out[canonical.lower() if canonical else None, token] = None
    return list(out)


def by_preferences(df: DataFrame, topics: list[str], blocked: list[str], tags: Column, text: Column, ts: Column, seq: Column) -> DataFrame:
    """score and blocked of each row; order with PREFERENCE_ORDER: blocked last, then score, then newest, then as given.

    A preferred topic gives 3 for its canonical tag, 2 for its token among the tags, 1 for its token in the text.
    """
    low = F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.lower(trim(t))), lambda t: t != "")
    canonical = F.transform(F.array_compact(F.transform(low, canonical_tag)), F.lower)
    joined, body = F.array_join(low, " "), F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("&"), F.lit(" and "))
    in_body = lambda token: F.col("_b").rlike("[^a-z0-9]+".join(token.split())) if " " in token else F.col("_b").contains(token)  # noqa: E731; as in match_text(), which costs much more
    rows = df.withColumn("_c", canonical).withColumn("_j", joined).withColumn("_b", body).withColumn("_ts", ts).withColumn("_seq", seq)
    score, block = F.lit(0), F.lit(False)
    for c, token in matchers(topics):
        if c:
            score = score + F.when(F.array_contains("_c", c), 3).otherwise(0)
        score = score + F.when(F.col("_j").contains(token), 2).otherwise(0) + F.when(in_body(token), 1).otherwise(0)
    for c, token in matchers(blocked):
        block = block | F.col("_j").contains(token) | (F.array_contains("_c", c) if c else F.lit(False))
    return rows.withColumn("score", score).withColumn("blocked", block).drop("_c", "_j", "_b")


PREFERENCE_ORDER = (F.asc, "blocked"), (F.desc, "score"), (F.desc_nulls_last, "_ts"), (F.asc, "_seq")


def preference_order() -> list[Column]:
    return [f(c) for f, c in PREFERENCE_ORDER]


def boost(sources: Column) -> Column:
    """3 if a source is well known, else 0."""
    return F.when(F.exists(sources, lambda s: bound(F.lower(F.coalesce(s, F.lit(""))), lambda low: any_of(low, BOOSTED_SOURCES))), 3).otherwise(0)


def group_keys(topics: list[str]) -> dict[str, Column]:
    """What GROUP_ORDER orders groups(perspectives, topic_tags, created_at) by: well-known sources, preferred topics, perspectives, time."""
    wanted = F.array(*(F.lit(t.lower()) for t in topics if t)).cast("array<string>")
    topic = F.size(F.filter("topic_tags", lambda t: F.array_contains(wanted, F.lower(t))))
    return {"_well": boost(F.col("perspectives.source")), "_topics": topic, "_n": F.size("perspectives"), "_created": F.col("created_at")}


GROUP_ORDER = "_well", "_topics", "_n", "_created"


def group_order() -> list[Column]:
    return [F.desc(c) for c in GROUP_ORDER]


def card_score(summary: Column, image: Column, sources: Column) -> Column:
    """What a card offers: bullets, an image, perspectives, distinct and well-known sources."""
    n, distinct = F.size(sources), F.size(F.array_distinct(F.transform(sources, lambda s: F.lower(F.coalesce(s, F.lit(""))))))
    return F.when(good_bullets(summary), 6).otherwise(0) + F.when(~placeholder_image(image), 3).otherwise(0) + F.least(F.lit(2), n - 1) + F.least(F.lit(2), distinct - 1) + boost(sources)


def social_score(has_url: Column, matched: Column, likes: Column, reposts: Column, replies: Column) -> Column:
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    return F.when(has_url, 5.0).otherwise(0.0) + F.when(matched, 3.0).otherwise(0.0) + zero(likes) + zero(reposts) * 2 + zero(replies) * 0.5


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with the place of each row in an order of all rows, from 1. Order by plain columns: expressions would be computed for the bounds of ranges, for the ranges and for each sort.

    Row numbers and the values that order are sorted in ranges, and ranges numbered by their sizes; all other columns join last.
    """
    rows = scratch(df.withColumn("_row", F.monotonically_increasing_id()), "unranked")  # written: the numbers stay
    places = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("_row", F.monotonically_increasing_id().alias("_i"))
    places = scratch(places, "ranked")
    part = F.shiftright("_i", 33)
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = places.groupBy(part.alias("_p")).agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # a row a range
    places = places.join(F.broadcast(sizes), part == F.col("_p")).select("_row", (F.col("_start") + F.col("_i").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias(name))
    return rows.join(places, "_row").drop("_row")


def interleaved(df: DataFrame, social: Column, order: list[Column], feed: str | None = None, interval: int = 5) -> DataFrame:
    """position: a social row after every interval-th other one, those left over at the end. Ranks are taken within a feed, or over all rows in ranges."""
    rows = df.withColumn("_social", F.coalesce(social, F.lit(False)))
    if feed:
        rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy(feed, "_social").orderBy(*order)))
        of = Window.partitionBy(feed)
        rows = rows.withColumn("_others", F.count_if(~F.col("_social")).over(of)).withColumn("_more", F.count_if("_social").over(of))
    else:  # others first, in one order of all rows
        counts = rows.agg(F.count_if(~F.col("_social")).alias("_others"), F.count_if("_social").alias("_more"))
        rows = ranked(rows, [F.asc("_social"), *order], "_k").crossJoin(F.broadcast(counts))  # one row
        rows = rows.withColumn("_k", F.col("_k") - F.when(F.col("_social"), F.col("_others")).otherwise(0))
    k, others = F.col("_k"), F.col("_others")
    of_social = F.when(k * interval <= others, k * interval + k).otherwise(others + k)
    of_other = k + F.least(F.floor((k - 1) / interval), F.col("_more"))
    return rows.withColumn("position", F.when(F.col("_social"), of_social).otherwise(of_other).cast("long")).drop("_social", "_k", "_others", "_more")


def images_first(seq: Column, image: Column) -> list[Column]:
    return [placeholder_image(image).asc(), seq.asc()]


def allowed_tags(df: DataFrame, id: str, text: Column, tags: list[str], most: int = 6) -> DataFrame:
    """The best of the allowed tags for each text; of equal scores in the order of the list."""
    rows = df.select(id, F.inline_outer(F.filter(allowed_tag_scores(text, tags), lambda x: x["score"] > 0))).where("score is not null")  # outer: no filter that would score again
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(id).orderBy(F.desc("score"), "pos"))).where(F.col("rank") <= most).select(id, "rank", "tag", "score")
