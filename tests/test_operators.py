import random

from pyspark.sql import functions as F

from brindle.functions.similarity import curation_tokens
from brindle.operators import aggregates, cluster, dedupe, enrich, filters, joins, knn, rank
from brindle.operators.views import story_groups
from brindle.sources import sinks
from brindle.streaming import ingest


def test_latest_ties_keep_the_first(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 5), (3, "b", 9), (4, "a", 4)], "seq int, k string, ts int")
    got = dedupe.latest(df, F.col("k"), F.col("ts"), F.col("seq"))
    assert sorted((r.k, r.seq, r.slot) for r in got.collect()) == [("a", 1, 1), ("b", 3, 3)]


def test_social_dedupe_is_sequential(spark):
    random.seed(1)
    rows = [(b, i, f"k{random.randint(0, 6)}", random.choice(["x", "y ", " Y", "", None, "z"])) for b in range(20) for i in range(random.randint(0, 12))]
    df = spark.createDataFrame(rows, "b int, seq int, k string, t string")
    want = []
    for b in range(20):
        keys, texts = set(), set()
        for _, i, k, t in [r for r in rows if r[0] == b]:
            t = " ".join((t or "").lower().split())
            if k in keys or (t and t in texts):
                continue
            keys.add(k)
            texts.add(t)
            want.append((b, i))
    got = dedupe.social(df, "b", F.col("k"), F.col("t"), F.col("seq"))
    assert sorted((r.b, r.seq) for r in got.collect()) == want


def test_two_tier(spark):
    df = spark.createDataFrame([(i, i < 3, i % 2) for i in range(8)], "i int, link boolean, likes int")
    run = lambda topics, enough: sorted(r.i for r in filters.two_tier(df, F.col("link"), F.lit(False), F.col("likes"), F.lit(0), topics, enough).collect())
    assert run(True, 3) == [0, 1, 2] and run(False, 9) == [0, 1, 2] and run(True, 9) == [0, 1, 2, 3, 5, 7]


def test_interleave(spark):
    df = spark.createDataFrame([(i, i >= 11) for i in range(15)], "i int, s boolean")
    got = [r.i for r in rank.interleaved(df, F.col("s"), [F.asc("i")]).orderBy("position").collect()]
    assert got == [0, 1, 2, 3, 4, 11, 5, 6, 7, 8, 9, 12, 10, 13, 14]


def test_preferences(spark):
    df = spark.createDataFrame([(0, ["ml"], "x", 5), (1, ["policy"], "AI and more", 9), (2, [], "ai", 1), (3, [], "ai", 2)], "seq int, tags array<string>, t string, ts int")
    got = rank.by_preferences(df, ["AI"], ["policy"], F.col("tags"), F.col("t"), F.col("ts"), F.col("seq")).orderBy(*rank.preference_order())
    assert [(r.seq, r.score, r.blocked) for r in got.collect()] == [(0, 3, False), (3, 1, False), (2, 1, False), (1, 1, True)]


def test_ranks_over_all_rows(spark):
    random.seed(5)
    rows = [(i, random.randint(0, 5)) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, v int").repartition(7)
    got = {r.i: r["rank"] for r in rank.ranked(df, [F.desc("v"), F.asc("i")]).collect()}
    assert got == {i: k for k, (i, v) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
    alone = rank.interleaved(df, F.col("v") == 0, [F.asc("i")]).collect()
    one = rank.interleaved(df.withColumn("f", F.lit(1)), F.col("v") == 0, [F.asc("i")], "f").collect()
    assert {r.i: r.position for r in alone} == {r.i: r.position for r in one}
    assert rank.ranked(df.limit(0), [F.asc("i")]).count() == 0


def test_neighbours_against_a_loop(spark):
    rng = random.Random(6)
    rows = [(i, f"s{rng.randint(0, 3)}", rng.sample("abc", rng.randint(0, 2)), [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)], 100 - i) for i in range(70)] + [(90, "s", ["a"], None, 0), (91, "s", ["a"], [], 0), (92, "s", None, [1.0] * 4, 0)]
    want = set()
    for i, _, t, x, _ in rows:
        if not x or not any(x) or not t:
            continue
        near = []
        for j, s, u, y, q in rows:
            if i != j and y and any(y) and u and set(t) & set(u):
                sim = sum(a * b for a, b in zip(x, y)) / (sum(a * a for a in x) * sum(b * b for b in y)) ** 0.5
                if sim >= 0.3 - 1e-12:
                    near.append((-round(sim, 9), q, j, s))
        of, n = {}, 0
        for sim, _, j, s in sorted(near):
            if n < 5 and of.get(s, 0) < 2:
                of[s] = of.get(s, 0) + 1
                n += 1
                want.add((i, j, n))
    df = spark.createDataFrame(rows, "id int, source string, tags array<string>, embedding array<double>, seq int")
    for tile in (1024, 9):
        got = knn.neighbours(df, 0.3 - 1e-9, 5, 2, tile).withColumn("sim", F.round("sim", 9))
        assert {(r.id, r.neighbour) for r in got.collect()} == {(a, b) for a, b, _ in want}


def test_leaders_against_a_loop():
    random.seed(2)
    items = [{"tokens": set(random.sample("abcdefgh", random.randint(0, 4)))} for _ in range(200)]
    leaders, want = [], []
    for i, x in enumerate(items):
        best, at = 0.0, None
        for j in leaders:
            y = items[j]["tokens"]
            s = len(x["tokens"] & y) / len(x["tokens"] | y) if x["tokens"] and y else 0
            if s > best:
                best, at = s, j
        if at is None or best < 0.4:
            leaders.append(i)
            at = i
        want.append(at)
    assert cluster.assign(items, 0.4, 2.0) == want


def test_topic_bonus_and_mean():
    items = [
        {"tokens": {"a"}, "embedding": [1.0, 0.0], "tags": ["X", "y"], "domain": "d"},
        {"tokens": {"b"}, "embedding": [0.7, 0.714], "tags": ["x", "Y"], "domain": "e"},
        {"tokens": {"a"}, "embedding": None, "tags": [], "domain": None},
        {"tokens": {"c"}, "embedding": [0.0, 1.0], "tags": [], "domain": "d"},
    ]
    assert cluster.assign(items, 0.22, 0.78, 0.25, 0.05, 2) == [0, 0, 0, 3]
    assert cluster.assign(items, 0.22, 0.78) == [0, 1, 0, 3]


FIXTURES = [
    ("a1", "techcrunch", "Nvidia unveils new Blackwell GPU for AI datacenters", 10), ("a2", "theverge", "Nvidia unveils Blackwell GPU aimed at AI", 11), ("a3", "arstechnica", "Chipmaker shows accelerator", 12),
]


def test_story_groups(spark):
    rows = [(i, s, "editorial", t, f"https://x/{i}", h, "", ["ai"], None, h) for i, s, t, h in FIXTURES]
    df = spark.createDataFrame(rows, "id string, source string, source_type string, title string, url string, h int, summary string, tags array<string>, image_url string, seq int").withColumn("published_at", F.timestamp_seconds(F.col("h") * 3600))
    got = story_groups(df).collect()
    assert len(got) == 1 and [p.id for p in got[0].perspectives] == ["a2", "a1"] and got[0].topic_tags == ["ai"]
    assert story_groups(df, threshold=0.99).count() == 0
    assert df.select(curation_tokens(F.col("title")).alias("t")).first().t[0] == "nvidia"


def test_tag_rankings(spark):
    df = spark.createDataFrame([(1, ["b", "a"]), (2, ["a", "c"]), (3, ["c"])], "seq int, tags array<string>")
    assert [r.tag for r in aggregates.top_tags(df, "tags", "seq", 2).collect()] == ["a", "c"]
    on = aggregates.onboarding_tags(spark.createDataFrame([(1, ["ux", "ml"]), (2, ["ml"])], "seq int, tags array<string>"), "tags", "seq", 3)
    assert [r.tag for r in on.orderBy("rank").collect()] == ["AI", "Design", "Startups"]


def test_audit(spark):
    items = spark.createDataFrame([("1", "s", "T", "t", "x" * 600, "/a.png"), ("2", "s", "T", "y" * 90, " ", None)], "id string, source_id string, title string, summary string, extracted_text string, image_url string")
    clusters = spark.createDataFrame([("c", "1"), ("c", "2"), ("c", "none")], "id string, item_id string")
    r = aggregates.audit(items, clusters, spark.createDataFrame([("/b.png",)], "path string")).first()
    assert (r.items, r.stories, r.img_missing, r.img_broken, r.short_text, r.title_only, r.one_source, r.under_three, r.invalid) == (2, 1, 1, 1, 1, 1, 1, 0, True)
    assert aggregates.audit(items.limit(0), clusters.limit(0)).first().invalid is False


def test_source_preferences(spark):
    d = spark.createDataFrame([("a", "A", True, 1), ("b", "B", True, 2)], "id string, name string, enabled boolean, seq long")
    own = spark.createDataFrame([("a", "Z", False, 1), (None, "b", False, 2), ("q", "Own", True, 3)], "id string, name string, enabled boolean, seq long")
    got = sorted((r.name, r.enabled) for r in joins.source_preferences(d, own).collect())
    assert got == [("A", False), ("B", False), ("Own", True)]


def test_enrich(spark):
    df = spark.createDataFrame([(1, "ai tools", ""), (2, "x", "")], "id long, title string, summary string")
    assert [r.output for r in enrich.with_tags(df).orderBy("id").collect()] == ['["AI"]', "[]"]
    model = lambda rows, strict: [f'["{t}"]' if strict or t == "x" else None for t in rows["title"]]
    assert [r.output for r in enrich.with_tags(df, model).orderBy("id").collect()] == ['["ai tools"]', '["x"]']


def test_streaming_upsert_and_windows(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    for k in range(3):
        events.where(F.dayofmonth("ts") % 3 == k).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    read = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest.upsert_latest(read(), "user_id", "ts", "event_id", str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
    got = {r.user_id: r.ts for r in ingest.latest_table(spark, str(tmp_path / "state"), "user_id").collect()}
    assert got == {r.user_id: r.t for r in events.groupBy("user_id").agg(F.max("ts").alias("t")).collect()}
    q = ingest.windowed_counts(read(), "ts", "event_type", late="60 days").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").agg(F.sum("n")).first()[0] == events.count()


def test_social_dedupe_of_random_clashes_equals_the_loop(spark):
    rng = random.Random(9)
    rows = [(rng.choice([0, 1, None]), i, f"k{rng.randrange(60)}" if rng.random() < 0.95 else None, rng.choice([" ", None, *(f"T  {rng.randrange(40)}" for _ in range(9))])) for i in range(900)]
    rows += [(2, 1000 + i, f"c{(i + 1) // 2}", f"chain {i // 2}") for i in range(24)]  # each clashes with the one before
    rows += [(3, 2000 + i, f"u{i}", "hot text") for i in range(2000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "b int, seq long, k string, t string")
    want, keys, texts = [], set(), set()
    for b, i, k, t in sorted(rows, key=lambda r: r[1]):
        t = " ".join((t or "").lower().split())
        if (b, k) not in keys and (not t or (b, t) not in texts):
            want.append(i)
            keys.add((b, k))
            texts.add((b, t))
    assert sorted(r.seq for r in dedupe.social(df, "b", F.col("k"), F.col("t"), F.col("seq")).collect()) == want
    assert dedupe.social(df.limit(0), "b", F.col("k"), F.col("t"), F.col("seq")).collect() == []
