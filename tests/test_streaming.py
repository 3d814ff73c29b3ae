"""Keyed state: what a micro-batch writes, replays, ties over batches, and folds."""

import os
import shutil

from pyspark.sql import functions as F

from brindle.streaming import ingest

SCHEMA = "id long, at long, seq long, `a.b` string"


def bytes_of(top):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(top) for f in names}


def land(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(path), mode="append")


def run(spark, tmp_path):
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    ingest.upsert_latest(stream, "id", "at", "seq", str(tmp_path / "table"), str(tmp_path / "checkpoint")).awaitTermination()
    return {r.id: (r["at"], r.seq, r["a.b"]) for r in ingest.latest_table(spark, str(tmp_path / "table"), "id").collect()}


def test_a_batch_writes_its_own_keys_only(spark, tmp_path):
    spark.range(60_000).select("id", F.lit(1).cast("long").alias("at"), F.col("id").alias("seq"), F.sha2(F.col("id").cast("string"), 256).alias("a.b")).coalesce(1).write.parquet(str(tmp_path / "in"))
    assert len(run(spark, tmp_path)) == 60_000
    first = bytes_of(tmp_path)
    for n in range(1, 4):
        land(spark, [(k * 100 + n, 2, 10**6 + k, f"new {n} {k}") for k in range(600)], tmp_path / "in")  # a hundredth of the state
        before = bytes_of(tmp_path)
        got = run(spark, tmp_path)
        new = {p: s for p, s in bytes_of(tmp_path).items() if before.get(p) != s and "/in/" not in p}
        assert sum(new.values()) < 0.1 * sum(first.values())
        assert len(got) == 60_000 and sum(v[0] == 2 for v in got.values()) == 600 * n and got[500 + n][2] == f"new {n} 5"


def test_ties_replays_and_folds(spark, tmp_path):
    land(spark, [(1, 5, 9, "x"), (2, None, 1, "none"), (None, 1, 1, "null"), (3, 1, 4, "a"), (3, 1, 3, "b")], tmp_path / "in")
    assert run(spark, tmp_path) == {1: (5, 9, "x"), 2: (None, 1, "none"), None: (1, 1, "null"), 3: (1, 3, "b")}
    land(spark, [(1, 5, 8, "first came"), (2, 0, 7, "old"), (3, 1, 5, "late"), (4, 1, 1, "new")], tmp_path / "in")
    want = {1: (5, 8, "first came"), 2: (0, 7, "old"), None: (1, 1, "null"), 3: (1, 3, "b"), 4: (1, 1, "new")}
    assert run(spark, tmp_path) == want and run(spark, tmp_path) == want  # nothing new: no batch
    commits = tmp_path / "checkpoint" / "commits"
    for name in ("1", ".1.crc"):  # the batch's rows were written, its commit was not: it runs again
        (commits / name).unlink(missing_ok=True)
    shutil.rmtree(tmp_path / "table" / "changes" / "v=1")
    assert run(spark, tmp_path) == want
    table = str(tmp_path / "table")
    for n in (2, 3):
        ingest.fold(spark, table, "id")
        ingest.fold(spark, table, "id")
        land(spark, [(4, n, 1, f"fold {n}")], tmp_path / "in")
        want[4] = (n, 1, f"fold {n}")
        assert run(spark, tmp_path) == want
    ingest.fold(spark, table, "id")
    assert sorted(os.listdir(tmp_path / "table" / "changes")) == ["v=3"] and sorted(os.listdir(tmp_path / "table" / "base")) == ["v=2", "v=3"]
    assert {r.id: (r["at"], r.seq, r["a.b"]) for r in ingest.latest_table(spark, table, "id").collect()} == want
    assert ingest.latest_table(spark, str(tmp_path / "nothing"), "id") is None
