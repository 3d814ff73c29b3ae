from pyspark.sql import functions as F

from brindle.operators import insights


def fnv(s):
    h = 2166136261
    for ch in s:
        h = ((h ^ ord(ch)) * 16777619) % 2**32
    return h


def test_mock_perspectives_and_insights(spark):
    df = spark.createDataFrame([("a", "T", "Src", "S", "u")], "id string, title string, source string, summary string, url string").withColumn("published_at", F.lit("2024-01-01").cast("timestamp"))
    got = insights.mock_perspectives(df).orderBy("id").collect()
    seed = fnv("a|T")
    assert [r.label for r in got] == ["Community", "Media", "Primary", "Skeptical"] and got[1].title == "T" and got[0].title == "T (Alt 2)"
    assert got[1].covered_by == ["Src", insights.COVERED_BY[0][(seed + 1) % 6], insights.COVERED_BY[1][(seed + 2) % 4], insights.COVERED_BY[2][(seed + 3) % 4]][: 3 + seed % 2]
    r = insights.mock_insights(df.withColumn("source_types", F.array(F.lit("editorial"), F.lit("community"), F.lit("editorial"))), F.lit("2024-02-01").cast("timestamp")).first()
    h = fnv("a")
    h = abs(h - 2**32 if h >= 2**31 else h)
    assert (r.selection.relevance, r.framing.political, r.coverage.media, r.coverage.agreement, r.confidence, r.speculation) == (min(100, 55 + h % 40), min(100, h % 101), 2, "Medium", "Medium", "Confirmed")


def test_packing(spark):
    p = lambda i, s, t, good=True: {"id": i, "source": s, "tokens": t, "good": good}
    assert insights.pack([p("1", "a", ["x", "y"]), p("2", "a", ["x", "y"]), p("3", "b", ["x"]), p("4", "c", ["q"]), p("5", "d", ["y"], False)]) == [["1", "3", "5"]]
    rows = [(i, s, t, "- one\n- two", 10 - i) for i, s, t in [(1, "a", "big chip news"), (2, "b", "big chip"), (3, "c", "chip news"), (4, "d", "other things"), (5, "e", "more big news"), (6, "f", "chip")]]
    df = spark.createDataFrame(rows, "id int, source string, title string, summary string, published_at int")
    groups = df.groupBy(F.lit("g").alias("id")).agg(F.collect_list(F.struct("*")).alias("perspectives"))
    got = insights.subgroups(groups).orderBy("subgroup").collect()
    assert got[0].ids == ["1", "2", "3"] and len(got) == 1
    assert insights.subgroups(groups, 6).first().ids == ["1", "2", "3", "4", "5", "6"]


def test_images_and_search(spark):
    items = spark.createDataFrame([("1", ["u1", "u2"], "u3", 1), ("2", None, "u1", 2)], "id string, c array<string>, page string, seq int")
    stored = spark.createDataFrame([("u1", "/1.png", 100), ("u2", "/2.png", 400), ("u3", "/3.png", 900)], "url string, path string, width int")
    got = {r.id: r.image for r in insights.chosen_image(F.col("c"), F.col("page"), stored, items).collect()}
    assert got == {"1": "/2.png", "2": "/placeholder.svg"}
    page = "see https://duckduckgo.com/html?q and https://a.b/c) https://x.y/l?uddg=https%3A%2F%2Fd.e&z=1 https://a.b/c"
    assert spark.range(1).select(insights.search_results(F.lit(page)).alias("x")).first().x == ["https://a.b/c", "https://x.y/l?uddg=https%3A%2F%2Fd.e&z=1"]
    assert spark.range(1).select(insights.search_results(F.lit('<a class="result__a" href="/l/?uddg=http%3A%2F%2Fq.r">x</a>')).alias("x")).first().x == ["http://q.r"]
