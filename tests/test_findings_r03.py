"""Inputs on which queries or operators gave wrong or unbounded results before round 3's findings were settled."""

import random

import duckdb
import pyspark.sql.functions as F

from brindle.operators import cluster, enrich, joins
from brindle.plans import queries_feed, queries_served, queries_text  # noqa: F401
from brindle.plans.registry import ORACLES, QUERIES


def same_as_sql(spark, folder, name, tables):
    """The query and its SQL over a folder of tables give the same rows; how many."""
    for t, df in tables.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
    con = duckdb.connect()
    for t in tables:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    got = QUERIES[name](spark, str(folder))
    want = con.sql(ORACLES[name]).df()
    columns = sorted(got.columns)
    rows = lambda df: sorted(map(tuple, df[columns].astype(object).where(df[columns].notna(), None).astype(str).values.tolist()))
    assert columns == sorted(want.columns)
    assert rows(got.toPandas()) == rows(want)
    return len(want)


def test_text_lines_trims_spaces_and_no_digits(spark, tmp_path):
    """Lines that begin or end with the number of their place, or with spaces of any width."""
    texts = ["0997 a 0", "a\n1 b 1\n2", " \xa0a \n b\u3000\n \n\tc\t ", "0", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert same_as_sql(spark, tmp_path, "text_lines", {"documents": docs}) == len(texts)


def test_trust_numbers_rounds_doubles(spark, tmp_path):
    """Prices whose digits and whose double round differently, and differences that Spark writes with an exponent."""
    prices = [32072.5, 40001.0, 130232.5, 261466.5, 40000.0, 257866.5, 39999.0, 259421.5, None, 123456.78]
    orders = spark.createDataFrame([(i, p) for i, p in enumerate(prices)], "o_orderkey long, o_totalprice double")
    assert same_as_sql(spark, tmp_path, "trust_numbers", {"orders": orders}) == len(prices) + 9
    assert QUERIES["trust_numbers"](spark, str(tmp_path)).where(F.col("safe").contains("E")).isEmpty()


def test_similar_sets_in_many_tiles_and_of_queries(spark):
    """Tiles of seven sets, of every size, and queries against all sets; classes of over a block are expanded whole."""
    rng = random.Random(3)
    sets = sorted({tuple(sorted(rng.sample("abcdefghijklmnopqrstuvwxyz", rng.randint(1, 14)))) for _ in range(90)})
    df = spark.createDataFrame([(k, list(s)) for k, s in enumerate(sets)], "key long, tok array<string>")
    sim = lambda a, b: len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]})
    n = range(len(sets))
    assert sorted(map(tuple, joins.similar_sets(df, 0.3, tile=7).collect())) == [(a, b, sim(a, b)) for a in n for b in n if a < b and sim(a, b) >= 0.3]
    assert sorted(map(tuple, joins.similar_sets(df, 0.3, df.where("key % 9 = 0"), tile=7).collect())) == [(a, b, sim(a, b)) for a in n for b in n if a % 9 == 0 and sim(a, b) >= 0.3]
    members = spark.range(joins.BLOCK * 2 + 5)
    got = joins.expanded(spark.createDataFrame([(7, 7, 1.0)], "ka long, kb long, sim double"), members.selectExpr("id as a", "7L as ka"), members.where("id < 3").selectExpr("id as b", "7L as kb"))
    assert got.select("a", "b").distinct().count() == got.count() == 3 * (joins.BLOCK * 2 + 5)


def test_title_leaders_of_all_rows_are_no_single_task(spark):
    """The fold's result by rounds, where later copies of a title find closer leaders than the first one had; groups apart."""
    rng = random.Random(5)
    rows = [(i, rng.sample("abcdefghijkl", rng.randint(0, 5)), i // 2, i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>, seq long, day int")
    for group in (None, "day"):
        want = {}
        for day in {r[3] for r in rows} if group else [None]:
            part = [r for r in rows if group is None or r[3] == day]
            want |= {part[i][0]: part[k][0] for i, k in enumerate(cluster.assign([{"tokens": set(r[1])} for r in part], 0.4, 2.0))}
        got = cluster.title_leaders(df, 0.4, group)
        assert {r.id: r.leader for r in got.collect()} == want
        assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().executedPlan().toString()


def test_equal_items_are_not_scored_again(monkeypatch):
    """Of 3,000 items, seven vectors and eleven titles, only those before the last change are scored; moved means still count."""
    scored = []
    monkeypatch.setattr(cluster, "_cosine", lambda a, b, real=cluster._cosine: scored.append(1) or real(a, b))
    items = [{"tokens": set() if i % 3 else {f"title{i % 11}"}, "embedding": [float(j == i % 7) for j in range(7)] if i % 3 else None} for i in range(3000)]
    got = cluster.assign(iter(items), 0.5, 0.85)
    first = {}
    assert got == [first.setdefault(i % 7 if i % 3 else f"t{i % 11}", i) for i in range(3000)]
    assert len(scored) < 100


def test_generated_outputs_are_not_joined(spark):
    """Rows pass through the model's tasks with all their columns, so nothing is shuffled; rows of one id keep their own outputs."""
    df = spark.createDataFrame([(1, "a", [1.5], None), (1, "b", [], "x"), (None, "c", None, "y"), (4, None, [2.0], "z")], "id long, text string, `odd.name` array<double>, title string")
    got = enrich.generated(df, "id", ["text"], lambda rows, strict: [t and t.upper() for t in rows["text"]], bool, F.lit("none"))
    assert sorted((r.text or "", r.output, r["odd.name"], r.title) for r in got.collect()) == [("", "none", [2.0], "z"), ("a", "A", [1.5], None), ("b", "B", [], "x"), ("c", "C", None, "y")]
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString() and got.columns == [*df.columns, "output"]


