"""Work that grew faster than its input, or was done more than once, before round 3's last findings were settled."""

import inspect
import re

import pytest
import pyspark.sql.functions as F

from brindle.operators import cluster, knn, rank
from brindle.plans import queries, queries_feed, queries_served, queries_text  # noqa: F401
from brindle.plans.registry import QUERIES


@pytest.mark.parametrize("name", ["group_rank_topk", "groups_ranked"])
def test_groups_are_ordered_by_plain_columns(spark, sf, monkeypatch, name):
    """What orders groups is computed once, not for the bounds of ranges, the ranges and the sorts."""
    orders = []
    monkeypatch.setattr(rank, "ranked", lambda df, order, *a, real=rank.ranked: orders.append(order) or real(df, order, *a))
    assert QUERIES[name](spark, sf).count() > 0
    assert len(orders) == 1 and all(re.fullmatch(r"\w+ (ASC|DESC) NULLS (FIRST|LAST)", c._jc.toString()) for c in orders[0])


def test_preferences_do_not_rewrite_texts(spark):
    """Tokens are found in lower-case texts as in match_text(), which would rewrite each text."""
    rows = [(0, "An OPEN -- Source thing"), (1, "opensource"), (2, "R&D"), (3, None), (4, "open source")]
    df = spark.createDataFrame(rows, "id long, t string").withColumn("tags", F.array().cast("array<string>"))
    got = rank.by_preferences(df, ["Open source", "and d"], [], F.col("tags"), F.col("t"), F.col("id"), F.col("id"))
    assert {r.id: r.score for r in got.collect()} == {0: 1, 1: 0, 2: 1, 3: 0, 4: 1}
    assert "regexp_replace(replace(lower(coalesce(t#" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_bullets_are_trimmed_without_regular_expressions(spark, sf):
    """Lines and texts lose the spaces at their ends by a look at the ends; a summary that is used twice is made once."""
    plan = QUERIES["bullet_forms"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "]+$" not in plan and plan.count("key points:?") == 1


def test_cosine_pairs_leave_a_task_in_parts(spark, monkeypatch):
    """Two tiles hand on their pairs as they find them; the topic fold runs once, though its rows are read twice."""
    from pyspark.sql import GroupedData

    made = []
    monkeypatch.setattr(GroupedData, "applyInPandas", lambda g, f, schema, real=GroupedData.applyInPandas: made.append(f) or real(g, f, schema))
    v = spark.createDataFrame([(i, 0, [1.0, float(i % 3)]) for i in range(30)], "vec_id long, label int, embedding array<double>")
    assert knn.cosine_pairs(v, 0.2).count() == 435 and inspect.isgeneratorfunction(made[-1])
    items = spark.createDataFrame([(i, i, ["a", "b"], None, [], "d") for i in range(3)], "id long, seq long, tokens array<string>, embedding array<double>, tags array<string>, domain string")
    got = cluster.topic_leaders(items)
    assert got.count() == 3 and "FlatMapGroups" not in got._jdf.queryExecution().optimizedPlan().toString()
