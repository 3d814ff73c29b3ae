import json
import os
import subprocess
import sys

from pyspark.sql import functions as F

from brindle.operators import aggregates, joins
from brindle.sources import feeds, sinks

def now():
    return F.lit("2024-01-02 00:00:00").cast("timestamp")


def test_rss(spark, tmp_path):
    (tmp_path / "f.xml").write_text(
        '<rss xmlns:media="m"><channel><item><title> A &amp; b </title><link>https://e.com/x/?utm_a=1</link><pubDate>Mon, 1 Jan 2024 10:00:00 GMT</pubDate><description>&lt;p&gt;Hi&lt;/p&gt;</description><media:content url="https://e.com/i.png"/></item><item><title></title><link>https://e.com/y</link></item></channel></rss>'
    )
    got = feeds.rss_items(feeds.read_rss(spark, str(tmp_path / "f.xml")), "s", "editorial", now()).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.title, r.url, r.summary, r.domain, str(r.published_at), r.image_url) == ("A & b", "https://e.com/x", "Hi", "e.com", "2024-01-01 10:00:00", "https://e.com/i.png")


def test_hits_and_comments(spark, tmp_path):
    (tmp_path / "h.json").write_text(json.dumps({"hits": [{"objectID": "7", "title": "T", "url": "https://e.com/a", "points": 3, "num_comments": 1, "created_at": "2024-01-01T00:00:00Z", "story_text": "<b>x</b>"}, {"objectID": "8", "title": "no url"}]}))
    got = feeds.hit_items(feeds.read_hits(spark, str(tmp_path / "h.json")), now()).collect()
    assert len(got) == 1 and got[0].signals.score == 3 and got[0].summary == "x"
    items = spark.createDataFrame([(2, "comment", "<p>b"), (3, "comment", " "), (4, "comment", "c"), (5, "job", "d")], "id long, type string, text string")
    stories = spark.createDataFrame([(1, [5, 4, 3, 2])], "id long, kids array<bigint>")
    assert feeds.top_comments(stories, items).first().comments == ["c", "b"]
    thread = json.dumps([{}, {"data": {"children": [{"data": {"body": "[deleted]"}}, {"data": {"body": " ok "}}]}}])
    assert spark.range(1).select(feeds.thread_comments(F.lit(thread)).alias("c")).first().c == ["ok"]


def test_catalogue_and_posts(spark):
    s = spark.createDataFrame([("a", "https://a/rss"), ("b", None)], "id string, rss string")
    q = spark.createDataFrame([("ai chips",)], "query string")
    got = {r.source_id: r.url for r in feeds.catalogue(s, q).collect()}
    assert set(got) == {"a", "hackernews", "google-news:ai chips"} and "ai%20chips" in got["google-news:ai chips"]
    p = spark.read.schema(feeds.POSTS).json(spark.sparkContext.parallelize([json.dumps({"uri": "at://x/y/rk", "author": {"handle": "h"}, "record": {"text": "short", "createdAt": "2024-01-01T00:00:00Z"}, "likeCount": 2})]))
    r = feeds.post_items(p, now()).first()
    assert (r.title, r.post_url, r.likes, r.reposts) == ("Post from @h", "https://bsky.app/profile/h/post/rk", 2, 0)
    assert feeds.mock_connector(spark, "hn", ["a", "b"], "2024-01-01").count() == 6


def test_publish_and_fall_back(spark, tmp_path):
    for n in (3, 4, 5, 6):
        sinks.publish({"articles": spark.range(n)}, str(tmp_path))
    assert sinks.snapshot(spark, f"{tmp_path}/clusters", f"{tmp_path}/articles").count() == 6
    assert sinks.versions(spark, f"{tmp_path}/articles") == [3, 4]  # what readers may still read, and the last
    assert sinks.snapshot(spark, f"{tmp_path}/none") is None
    (tmp_path / "bad.json").write_text('[{"a":1},')
    (tmp_path / "good.json").write_text('[{"a":1},{"a":2}]')
    assert sinks.json_or_none(spark, f"{tmp_path}/bad.json", "a int") is None and sinks.json_or_none(spark, f"{tmp_path}/no.json", "a int") is None
    assert sinks.json_or_none(spark, f"{tmp_path}/good.json", "a int").count() == 2


def test_a_version_without_its_mark_is_not_read(spark, tmp_path):
    sinks.write_version(spark.range(3), str(tmp_path / "t"), 1)
    spark.range(9).write.parquet(str(tmp_path / "t" / "v=2"))
    (tmp_path / "t" / "v=2" / "_SUCCESS").unlink()
    assert sinks.current(spark, str(tmp_path / "t")).count() == 3


def test_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert sinks.cache_read(spark, path, 0, 100) is None
    assert sinks.cache_write(spark.range(2), path, 1000) and sinks.cache_write(spark.range(5), path, 2000)
    assert sinks.cache_read(spark, path, 2099, 100).count() == 5 and sinks.cache_read(spark, path, 2100, 100) is None and sinks.cache_read(spark, path, 9999, None).count() == 5
    (tmp_path / "file").write_text("")
    assert not sinks.cache_write(spark.range(1), f"{tmp_path}/file/cache", 3000)  # no folder can be there


def test_feeds_of_three_formats_in_one_folder(spark, tmp_path):
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A</title><link rel="self" href="http://no/"/><link href="http://a.org/1"/><content type="xhtml"><div xmlns="http://www.w3.org/1999/xhtml">one <b>two</b></div></content></entry><entry><title>no link</title><id>urn:1</id></entry></feed>'
    rdf = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:r="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/"><r:channel/><r:item><r:title>D</r:title><r:link>http://d.org/1</r:link><dc:creator>Dan</dc:creator></r:item></rdf:RDF>'
    rss = '<rss xmlns:atom="http://www.w3.org/2005/Atom"><channel><item><title>R</title><atom:link href="http://no/"/><link>http://r.org/1</link></item></channel></rss>'
    for name, body in (("a", atom), ("d", rdf), ("r", rss), ("broken", "<feed><entry>"), ("empty", ""), ("page", "<html><entry/></html>")):
        (tmp_path / f"{name}.xml").write_text(body)
    rows = feeds.rss_items(feeds.read_rss(spark, str(tmp_path)), "s", "editorial", now(), keep=("format",)).collect()
    assert sorted((r.format, r.title, r.url, r.author, r.summary) for r in rows) == [("atom", "A", "http://a.org/1", None, "one two"), ("rdf", "D", "http://d.org/1", "Dan", ""), ("rss", "R", "http://r.org/1", None, "")]


def test_flush_goes_on_where_it_was_broken_off(spark, tmp_path):
    """A process that dies in its third portion; the next one makes the rest from what the first has dealt, without another scan."""
    spark.range(0, 5000, 1, 4).selectExpr("id", "repeat('x', 20) as text").write.parquet(str(tmp_path / "items"))
    script = f"""
import os
from pyspark.sql import SparkSession, functions as F
from brindle.sources import sinks
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
made = []
def make(rows):
    made.append(rows.count())
    if len(made) == 3:
        os._exit(9)
    return rows.withColumn("x", F.col("id") * 2)
sinks.flushed(spark.read.parquet({str(tmp_path / "items")!r}), "id", make, {str(tmp_path / "parts")!r}, 5)
"""
    died = subprocess.run([sys.executable, "-c", script], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), capture_output=True, timeout=120)
    assert died.returncode == 9 and sorted(p.name for p in tmp_path.glob("parts/part=*")) == ["part=0", "part=1"]
    kept = {p: p.stat().st_mtime_ns for p in tmp_path.glob("parts/part=*/*")}
    scanned = spark.sparkContext.accumulator(0)

    def seen(frames):
        for f in frames:
            scanned.add(len(f))
            yield f

    made, items = [], spark.read.parquet(str(tmp_path / "items")).mapInPandas(seen, "id long, text string")
    make = lambda rows: made.append(rows.count()) or rows.withColumn("x", F.col("id") * 2)
    got = sinks.flushed(items, "id", make, str(tmp_path / "parts"), 5)
    assert sorted((r.id, r.x) for r in got.collect()) == [(i, 2 * i) for i in range(5000)] and len(made) == 3 and scanned.value == 0
    assert {p: p.stat().st_mtime_ns for p in kept} == kept and not (tmp_path / "parts" / "_dealt").exists()
    assert sinks.flushed(items, "id", make, str(tmp_path / "parts"), 5).count() == 5000 and len(made) == 3
    sinks.flushed(items, "id", make, str(tmp_path / "more"), 7)
    assert scanned.value == 5000 and len(made) == 10  # one scan, seven portions
    assert sinks.flushed(items.where("id < 2"), "id", make, str(tmp_path / "few"), 6).count() == 2


def _scanned(df):
    """Rows that the scans of an executed plan gave."""
    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), 0
    todo = [plan.finalPhysicalPlan() if plan.nodeName().startswith("Adaptive") else plan]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Scan parquet"):
            out += node.metrics().apply("numOutputRows").value()
        if node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return out


def test_a_look_for_some_keys_reads_some_files(spark, tmp_path):
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    rows = spark.range(120_000).select(F.sha2(F.col("id").cast("string"), 256).alias("url"), "id", F.to_date(F.lit("2024-01-01")).alias("day"))
    try:
        spark.conf.set(name, "500k")
        sinks.write_version(rows.repartition(8), str(tmp_path / "t"), 1, key="url")
    finally:
        spark.conf.set(name, before)
    table = sinks.current(spark, str(tmp_path / "t"))
    files = len(table.inputFiles())
    assert files >= 4
    there = rows.where("id = 77").select("url")
    missing = spark.createDataFrame([(f"{k:064x}"[::-1],) for k in range(1, 4)], "url string")  # within the files' ranges: Bloom filters tell
    assert sinks.known(there, "url", table).select("id").collect()[0].id == 77
    assert 0 < _scanned(sinks.known(there, "url", table)) <= 120_000 / files * 1.6
    assert _scanned(sinks.known(missing, "url", table)) < 120_000 / 2
    for n in (20, 3000):  # as values, and as a join
        asked = rows.where(F.col("id") < n).select("url").unionByName(missing).unionByName(spark.createDataFrame([(None,)], "url string"))
        assert sorted(r.id for r in sinks.known(asked, "url", table).collect()) == list(range(n))
        got = joins.unseen_in(asked.where("url is not null"), table, "url")
        assert {r.url for r in got.collect()} == {r.url for r in missing.collect()}
    assert sinks.known(missing.limit(0), "url", table).count() == 0


def test_sketches_stand_for_old_versions(spark, tmp_path):
    days = [spark.range(k * 4000, k * 4000 + 6000).select((F.col("id") % 3).alias("g"), "id", F.lit(k).alias("day")) for k in range(5)]
    for k, rows in enumerate(days):
        aggregates.sketched(rows, ["g"], "id").write.parquet(str(tmp_path / f"v={k}"))
    got = {r.g: (r.n, r.id) for r in aggregates.sketches_merged(spark.read.parquet(str(tmp_path)), ["g"], "id").collect()}
    assert all(n == 10_000 and abs(x - 22_000 / 3) < 0.03 * 22_000 / 3 for n, x in got.values()) and len(got) == 3
    assert sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")) < 600_000


def test_images(spark, tmp_path):
    for name, raw in (("a", b"\xff\xd8\xff1"), ("b", b"\x89PNG1"), ("c", b"none"), ("d", b""), ("e", b"RIFF0000WEBP"), ("f", b"\xff\xd8\xff" + b"0" * 99)):
        (tmp_path / name).write_bytes(raw)
    assert sorted(r.extension for r in feeds.images(spark, str(tmp_path), 50).collect()) == ["jpg", "png", "webp"]
