"""Texts far longer than any in the tables, through the operators that test_bpe_and_tokens has not, and through the pipeline."""

import hashlib

from pyspark.sql import functions as F

import corpus_pipeline
from brindle.llm import decontam, filteraudit, quality, sadedup, urlfilter, veccodes, vecdup, warc
from brindle.llm.common import table

LONG = " ".join(f"word{k % 9973} é" for k in range(400_000))  # about 4 MB


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_long_texts(spark, sf):
    item = "these are the words of one benchmark item that nobody else would ever write in that order"
    rows = docs(spark, [(1, LONG, "en", "s", len(LONG)), (2, LONG + " " + item, "en", "s", 1), (3, "x", "en", "s", 1)])
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in sadedup.dedup(rows, 50).collect()}
    n = len(LONG.encode())
    assert got[1][0] == n and got[2][1] >= n and got[3] == (1, 0)
    labels = table(spark, sf, "labels")
    scores = {r.doc_id: r.score for r in quality.classify(rows.unionByName(table(spark, sf, "documents").where("doc_id > 3")), labels).where("doc_id < 4").collect()}
    assert len(scores) == 3 and all(0 <= s <= 1 for s in scores.values())
    leaks = {r.doc_id: r.contaminated for r in decontam.contamination(rows, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert leaks == {1: False, 2: True, 3: False}
    pages = rows.select(F.col("doc_id").alias("page_id"), F.lit("http://a.com/").alias("url"), F.col("text").alias("html"))
    got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in warc.converted(pages).collect()}
    assert got[1] == (n, hashlib.sha1(LONG.encode()).hexdigest()) and len(got) == 3
    audit = filteraudit.audit(rows.unionByName(rows.withColumn("doc_id", F.col("doc_id") + 10)), labels.limit(0)).where("filter_order = 'EABCD' and step = 1").collect()
    assert [(r.kept, r.removed) for r in audit] == [(3, 3)]
    verdicts = urlfilter.judge(pages.withColumn("url", F.concat(F.lit("http://x.org/"), F.substring("html", 1, 1_000_000)))).collect()
    assert len(verdicts) == 3 and {len(r.path) for r in verdicts} == {1_000_001, 2}


def test_long_vectors(spark):
    e = [float(k % 7 - 3) for k in range(20_000)]
    v = spark.createDataFrame([(1, 0, e), (2, 0, e[:-1] + [9.0]), (3, 0, [-x for x in e])], "vec_id long, label int, embedding array<double>")
    assert {r.vec_id: r.component_id for r in vecdup.near_duplicates(v, 0.93).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r.vec_id: r.error for r in veccodes.compress(v).collect()} == {1: 0, 2: 0, 3: 0}


def test_long_texts_in_the_pipeline(spark, sf):
    rows = table(spark, sf, "documents").limit(30).select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    rows = rows.unionByName(docs(spark, [(800_001, LONG, "en", "s", len(LONG)), (800_002, LONG + " more", "en", "s", len(LONG) + 5)]))
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        got = {r.doc_id: len(r.text or "") for r in stage(spark, rows, sf).where("doc_id > 800000").collect()}
        assert got.pop(800_001) == len(LONG), name
        assert (got == {}) if name == "near_duplicates" else (got[800_002] < 100) if name == "repeated_passages" else got == {800_002: len(LONG) + 5}
    last = {r.doc_id: r.n_tokens for r in corpus_pipeline.STAGES[-1][1](spark, rows, sf).where("doc_id > 800000").collect()}
    assert last[800_002] >= last[800_001] > 400_000
