from pyspark.sql import functions as F

from brindle.functions.urls import canonical_url, domain
from brindle.operators import rank
from brindle.plans import build, serving
from brindle.sources import sinks


def make(spark, sf, n=60):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where(F.col("doc_id") < n)
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    url = canonical_url(F.concat(F.lit("https://www.example.com/"), F.col("doc_id") % 50))
    return docs.join(vectors, "doc_id", "left").select(
        F.concat(F.lit("d"), "doc_id").alias("id"), F.col("doc_id").alias("seq"), F.col("source").alias("source_id"), F.lit("editorial").alias("source_type"), F.substring("text", 1, 60).alias("title"), url.alias("url"), url.alias("canonical_url"),
        F.substring("text", 1, 300).alias("summary"), F.col("text").alias("extracted_text"), domain(url).alias("domain"), (F.lit("2024-01-20").cast("timestamp") + F.make_dt_interval(hours=F.col("doc_id").cast("int"))).alias("published_at"), "embedding", F.lit(None).cast("string").alias("image_url"),
    )


def test_build_and_publish(spark, sf, tmp_path):
    rows = make(spark, sf)
    got = build.items(rows, None, "2024-01-24 00:00:00", blocked=())
    assert got.groupBy("canonical_url").count().where("count > 1").count() == 0
    assert got.where("seq < 10").count() == 0  # 50 to 59 are newer
    again = build.items(rows, got.drop("tags"), "2024-01-24 00:00:00", blocked=())
    assert sorted(r.id for r in again.select("id").collect()) == sorted(r.id for r in got.select("id").collect())
    sources = rows.select(F.col("source_id").alias("id"), F.upper("source_id").alias("name")).distinct()
    tables = build.tables(got.cache(), sources)
    sinks.publish(tables, str(tmp_path))
    assert sinks.snapshot(spark, f"{tmp_path}/articles").where("source = upper(source_id)").count() == got.count()
    trust = build.trust_backfill(got, tables["trust_fields"].limit(3))
    assert trust.count() == got.count()
    assert build.retag(got, got.select("id", F.array(F.lit("AI")).alias("tags")).limit(5)).count() == got.count()
    assert build.refreshed_summaries(got, got.select("id", F.array(F.lit("one"), F.lit("two")).alias("bullets"))).where("size(bullets) > 5").count() == 0


def test_serving(spark, sf):
    rows = make(spark, sf).withColumn("post_url", F.lit(None).cast("string")).withColumn("source", F.col("source_id")).withColumn("tags", F.array(F.lit("ai"))).withColumn("text", F.col("summary"))
    prefs = serving.Preferences(["AI"], [])
    off = rows.select(F.col("source").alias("name"), F.lit(False).alias("enabled")).limit(1)
    got = serving.rank_items(rows, prefs, {"x": rows.limit(3).withColumn("source_type", F.lit("social")).withColumn("url", F.lit(None).cast("string"))}, off).collect()
    assert got and all(r.score >= 5 for r in got) and len({r.url for r in got if r.url}) == len([r for r in got if r.url])
    assert sorted(r.rank for r in serving.rank_items(rows, serving.Preferences()).collect()) == list(range(1, 51))
    assert sorted(r.rank for r in got) == list(range(1, len(got) + 1))
    posts = rows.select("id", F.when(F.col("seq") % 2 == 0, F.col("url")).alias("url"), "post_url", "text", (F.col("seq") % 5).alias("likes"), F.lit(0).alias("reposts"), F.lit(0).alias("replies"), "seq")
    feed = serving.social_feed(posts, ("ai",)).collect()
    assert 0 < len(feed) <= 60 and [r.score for r in feed] == sorted((r.score for r in feed), reverse=True)


def test_social_feed_fills_up_past_repeats(spark):
    rows = [(str(i), f"u{i // 40}" if i < 400 else f"v{i}", None, f"t{i}", 500 - i, 0, 0, i) for i in range(450)]
    posts = spark.createDataFrame(rows, "id string, url string, post_url string, text string, likes int, reposts int, replies int, seq int")
    got = [r.seq for r in serving.social_feed(posts, (), 40).collect()]
    assert got == [*range(0, 400, 40), *range(400, 430)]


def test_ranking_leaves_texts_where_they_are(spark, sf, monkeypatch):
    written = []
    real = rank.scratch
    monkeypatch.setattr(rank, "scratch", lambda df, tag: written.append((tag, df.columns)) or real(df, tag))
    rows = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("post_url"), "source", F.when(F.col("source") == "src0", "social").otherwise("editorial").alias("source_type"), F.lit("").alias("title"), "text", F.array(F.lit("AI")).alias("tags"), F.col("n_chars").alias("published_at"), F.col("doc_id").alias("seq"))
    out = serving.rank_items(rows, serving.Preferences(["AI"], ["policy"]))
    assert len(written) == 4 and not any("text" in c or "tags" in c for _, c in written)
    assert [c for t, c in written if t == "ranked"] == [["_row", "_i"]] * 2
    assert sorted(r["rank"] for r in out.select("rank").collect()) == list(range(1, rows.count() + 1)) and "text" in out.columns
