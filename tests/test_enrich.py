"""Calls of models: how many at once, how fast, and what is asked again."""

import json
import time

from pyspark import TaskContext
from pyspark.sql import functions as F

from brindle.operators import enrich


def logger():
    """A function that tasks can take along."""

    def logged(path, what):
        with open(path, "a") as f:
            f.write(json.dumps(what) + "\n")

    return logged


def read(path):
    return [json.loads(x) for x in path.read_text().splitlines()] if path.exists() else []


def test_calls_are_bounded_and_the_scan_is_not(spark, tmp_path):
    calls, scans, logged = tmp_path / "calls", tmp_path / "scans", logger()

    def scan(frames):
        for f in frames:
            logged(scans, TaskContext.get().partitionId())
            yield f

    def model(rows, strict):
        begun = time.time()
        time.sleep(0.05)
        logged(calls, (begun, time.time(), len(rows)))
        return [f"made {x}" for x in rows["x"]]

    rows = spark.range(0, 400, 1, 8).selectExpr("id", "cast(id as string) as x").mapInPandas(scan, "id long, x string")
    out = enrich.generated(rows, "id", ["x"], model, bool, F.lit("none"), batch=10, concurrency=2)
    assert {r.id: r.output for r in out.collect()} == {i: f"made {i}" for i in range(400)}
    assert len(set(read(scans))) == 8
    times = read(calls)
    edges = sorted([(a, 1) for a, _, _ in times] + [(b, -1) for _, b, _ in times])
    now = most = 0
    for _, step in edges:
        now += step
        most = max(most, now)
    assert most == 2 and sum(n for *_, n in times) == 400


def test_a_rate_is_shared_by_the_tasks(spark, tmp_path):
    calls, logged = tmp_path / "calls", logger()

    def model(rows, strict):
        logged(calls, time.time())
        return list(rows["x"])

    rows = spark.range(24).selectExpr("id", "cast(id as string) as x")
    enrich.generated(rows, "id", ["x"], model, bool, F.lit("none"), batch=2, concurrency=2, pace=enrich.Pace(rate=8)).collect()
    times = sorted(read(calls))
    assert len(times) >= 12 and times[-1] - times[0] >= (len(times) - 2) / 8 * 0.9  # each task begins at once


def test_failures_are_told_apart(spark, tmp_path):
    calls, logged = tmp_path / "calls", logger()

    def model(rows, strict):
        kind = rows["x"].iloc[0]
        logged(calls, (kind, time.time(), strict))
        if kind == "refused":
            raise enrich.Refused
        if kind == "throttled" and not strict:
            raise enrich.Throttled(0.4)
        if kind == "broken":
            raise ConnectionError
        return [None if kind == "invalid" and not strict else f"ok {kind}"]

    rows = spark.createDataFrame([(i, x) for i, x in enumerate(("refused", "throttled", "broken", "invalid", "good"))], "id long, x string")
    out = enrich.generated(rows, "id", ["x"], model, bool, F.lit("fallback"), batch=1, attempts=3, concurrency=1, pace=enrich.Pace(wait=0.1))
    assert {r.x: r.output for r in out.collect()} == {"refused": "fallback", "throttled": "ok throttled", "broken": "fallback", "invalid": "ok invalid", "good": "ok good"}
    times = {k: [t for kind, t, _ in read(calls) if kind == k] for k in ("refused", "throttled", "broken", "invalid", "good")}
    assert {k: len(v) for k, v in times.items()} == {"refused": 1, "throttled": 2, "broken": 3, "invalid": 2, "good": 1}
    gaps = [b - a for a, b in zip(times["broken"], times["broken"][1:])]
    assert times["throttled"][1] - times["throttled"][0] >= 0.4 and 0.07 <= gaps[0] < 0.4 and 0.14 <= gaps[1] < 0.6 and times["invalid"][1] - times["invalid"][0] < 0.07


def test_waits_grow_to_a_bound():
    pace = enrich.Pace(wait=1.0, most=10.0)
    for n, mean in enumerate((1, 2, 4, 8, 10, 10)):
        assert all(0.7 * mean <= pace.delay(n) <= 1.3 * mean for _ in range(50))
    assert len({pace.delay(0) for _ in range(9)}) > 1


def test_every_generator_takes_what_is_valid_only(spark):
    rows = spark.createDataFrame([(1, "T", "- one\n- two", "body " * 200, ["c1"])], "id long, title string, summary string, extracted_text string, comments array<string>")
    bullets, text = "\n".join(f"- bullet {k} " + "x" * 40 for k in range(4)), "long " * 100
    good = {"tags": '["AI"]', "summary": bullets, "lite_summary": bullets, "title_only": "- T", "bundle": '{"summary":[],"bias":0}', "trust": '{"whats_missing":[],"so_what":{},"framing":{}}', "reaction": "r", "bias": '{"vestedInterests":1,"framingBias":2,"confidence":3}', "missing": "m", "impact": '{"shortTerm":1,"longTerm":2}', "claims": '{"claims":[]}', "long_text": text}
    assert set(good) == set(enrich.GENERATORS)
    for name, g in enrich.GENERATORS.items():
        made = lambda x, g=g: g(rows, lambda r, strict: [x] * len(r)).first().output
        fallback = g(rows).first().output
        assert made(good[name]) == good[name] and made("") == made(None) == fallback
        if name in ("summary", "lite_summary", "missing", "long_text"):
            assert made("As an AI " + good[name]) == fallback
        if good[name].startswith("{"):
            assert made("{}") == made("[1") == (fallback)
