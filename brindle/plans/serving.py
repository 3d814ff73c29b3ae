"""Serving plans: a ranked feed, the social connector, lookups. Preferences are parameters, never scanned."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tags as T
from ..operators import dedupe, filters, joins, rank
from ..operators.views import solo_groups
from ..sources import feeds
from ..sources.sinks import scratch


@dataclass
class Preferences:
    topics: list[str] = field(default_factory=list)
    blocked: list[str] = field(default_factory=list)
    sources_off: list[str] = field(default_factory=list)


def rank_groups(groups: DataFrame, prefs: Preferences) -> DataFrame:
    """Story groups with rank, from 1: sources switched off go, then source quality, topics, perspectives and time, then preferences."""
    rows = filters.allowed_perspectives(groups, [s.lower().strip() for s in prefs.sources_off]) if prefs.sources_off else groups
    score = rank.by_preferences(rows, prefs.topics, prefs.blocked, F.col("topic_tags"), F.col("title"), F.col("created_at"), F.lit(0))
    keyed = score.withColumns(rank.group_keys(prefs.topics))
    return rank.ranked(keyed, [F.asc("blocked"), F.desc("score"), F.desc("_ts"), *rank.group_order(), F.asc("id")]).drop("_ts", "_seq", *rank.GROUP_ORDER)


def merged(items: DataFrame, connectors: dict[str, DataFrame], enabled: set[str] | None = None) -> DataFrame:
    """Items, then the rows of enabled connectors (all if none are named); the first of each key stays."""
    rows = items
    for k, (name, more) in enumerate(connectors.items()):
        if enabled is None or name in enabled:
            rows = rows.unionByName(more.withColumn("seq", F.col("seq") + F.lit((k + 1) << 40)), allowMissingColumns=True)
    return dedupe.first_wins(rows, dedupe.item_key(), F.col("seq"))


def feed(catalogue: DataFrame, landed: DataFrame, key: str, now) -> DataFrame:
    """Items of the catalogue(key, source_id, source_name, source_type) and its landed documents(key, body), the newest of each URL;
    a source whose document is missing or doesn't parse gives none. Order: published_at, newest first, then slot."""
    rows = feeds.parse_rss(catalogue.join(landed, key), "body")
    items = feeds.rss_items(rows, F.col("source_id"), F.col("source_type"), now, keep=("source_name",)).withColumnRenamed("source_name", "source")
    return dedupe.latest(items, F.col("url"), F.col("published_at"), F.struct("source_id", "id", "title"))


def rank_items(items: DataFrame, prefs: Preferences, connectors: dict[str, DataFrame] | None = None, sources: DataFrame | None = None) -> DataFrame:
    """Feed items with rank, from 1: allowed sources, with connectors' rows merged in, social rows interleaved, then preferences.

    items(id, url, post_url, source, source_type, title, text, tags, published_at, seq).
    """
    rows = filters.allowed_sources(items, F.col("source"), sources) if sources is not None else items
    rows = merged(rows, connectors or {}).withColumn("_item", F.monotonically_increasing_id())
    text = F.concat_ws(" ", "title", "text")
    scored = scratch(rank.by_preferences(rows, prefs.topics, prefs.blocked, F.col("tags"), text, F.col("published_at"), F.col("seq")), "feed")  # texts are read once
    rows = scored.select(*rows.columns)
    keys = scored.select("_item", "score", "blocked", "_ts", "_seq", (F.col("source_type") == "social").alias("_social"))  # what orders rows, without their texts
    keys = rank.interleaved(keys, F.col("_social"), [F.desc("_ts"), F.asc("_seq")]).withColumn("_seq", F.col("position"))
    if prefs.topics or prefs.blocked:
        keys = rank.ranked(keys, rank.preference_order()).drop("_ts", "_seq", "_social")
    else:
        keys = keys.select("_item", "position", F.col("position").alias("rank"))
    return rows.join(keys, "_item").drop("_item")


def social_feed(posts: DataFrame, topics: tuple[str, ...], limit: int = 60) -> DataFrame:
    """Posts(id, url, post_url, text, likes, reposts, replies, seq): two-tier filter, score order, sequential dedupe, 20 to 120 rows."""
    limit = min(120, max(20, limit))
    matched = F.size(T.social_topics(F.col("text"), topics)) > 0
    rows = filters.two_tier(posts.withColumn("matched", matched), F.col("url").isNotNull(), F.col("matched"), F.col("likes"), F.col("reposts"), bool(topics))
    rows = rows.withColumn("score", rank.social_score(F.col("url").isNotNull(), F.col("matched"), F.col("likes"), F.col("reposts"), F.col("replies")))
    best = F.struct((-F.col("score")).alias("score"), F.col("seq").alias("seq"))
    kept = dedupe.social(rows.withColumn("feed", F.lit(0)), "feed", dedupe.item_key(), F.col("text"), best)
    return kept.drop("feed").orderBy(F.desc("score"), "seq").limit(limit)


def fetched(timeline: DataFrame, searches: DataFrame, per_query: int = 25, of_timeline: int = 50, queries: int = 6) -> DataFrame:
    """Posts of the timeline(seq), then of the searches(query, seq) in their order, the first of each; seq is counted anew."""
    own = timeline.orderBy("seq").limit(of_timeline).withColumn("_q", F.lit(-1))
    rows = searches.where(F.col("query") < queries).withColumn("_k", F.row_number().over(Window.partitionBy("query").orderBy("seq"))).where(F.col("_k") <= per_query)
    both = own.unionByName(rows.withColumn("_q", F.col("query")).drop("_k", "query"), allowMissingColumns=True)
    return both.withColumn("seq", F.row_number().over(Window.orderBy("_q", "seq")).cast("long")).drop("_q")  # at most a few hundred rows


def unseen_cards(cards: DataFrame, groups: DataFrame) -> DataFrame:
    """Extra cards (url, bullets) whose URL no perspective has and that have four bullets or more."""
    seen = groups.select(F.explode("perspectives.url").alias("url")).distinct()
    filled = F.size(F.filter("bullets", lambda b: F.trim(b) != ""))
    return joins.unseen(cards, seen, "url").where(filled >= 4)


def with_cards(groups: DataFrame, items: DataFrame, now) -> DataFrame:
    """Groups, and a group of its own for each item that no group has and that has four bullets or more."""
    return groups.unionByName(solo_groups(unseen_cards(items, groups), now), allowMissingColumns=True)
