"""Work that grew faster than its results, or memory with the input, before round 4's findings were settled."""

import collections
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brindle.operators import cluster, joins, views


def test_members_of_classes_meet_after_the_last_shuffle(spark, monkeypatch):
    """Blocks of members are shuffled, not the pairs made of them; within one table two members of a class are a pair once."""
    monkeypatch.setattr(joins, "BLOCK", 3)
    members = spark.createDataFrame([(i, i % 3) for i in range(40)], "a long, ka long")
    pairs = spark.createDataFrame([(0, 0, 1.0), (2, 2, 1.0), (0, 1, 0.5)], "ka long, kb long, sim double")
    got = joins.expanded(pairs, members)
    want = [(a, b) for a, b in itertools.combinations(range(40), 2) if {a % 3, b % 3} in ({0}, {2}, {0, 1})]
    assert sorted((min(r.a, r.b), max(r.a, r.b)) for r in got.collect()) == want
    above = got._jdf.queryExecution().optimizedPlan().toString().split("Repartition")[0]
    assert above.count("Generate explode") == 2 and "Join" not in above


def task(sets, side):
    """What a task of similar_sets() gets: packs of either side, words as numbers in order of their sets."""
    many = collections.Counter(itertools.chain(*sets))
    place = {w: k for k, w in enumerate(sorted(many, key=many.get))}
    packs = []
    for x in sorted({*side}):
        own = [k for k in range(len(sets)) if side[k] == x]
        t = pa.table({"tile": [x] * len(own), "n": pa.array([len(sets[k]) for k in own], pa.int64()), "key": own, "tok": [sorted(place[w] for w in sets[k]) for k in own]})
        packs.append(joins._packed(t).append_column("side", pa.array([x] * -(-len(own) // joins.PACK))))
    return pa.concat_tables(packs)


def test_sets_that_share_no_word_cost_nothing(monkeypatch):
    """3,000 sets of own words and three similar ones: what is counted goes by shared words, not by pairs of sets."""
    counted = []
    monkeypatch.setattr(np, "bincount", lambda x, *a, real=np.bincount, **b: counted.append(max(len(x), b.get("minlength", 0))) or real(x, *a, **b))
    sets = [[f"{k}-{i}" for i in range(4)] for k in range(3000)] + [list("abcd"), list("abce"), list("abcf")]
    got = joins._similar(task(sets, [0] * len(sets)), 0.5).to_pydict()
    assert sorted(zip(got["ka"], got["kb"], got["sim"], strict=True)) == [(3000, 3001, 0.6), (3000, 3002, 0.6), (3001, 3002, 0.6)]
    assert max(counted) <= 4 * len(sets)


@pytest.mark.parametrize("often", [64, 128])
def test_frequent_words_are_counted_as_bits(monkeypatch, often):
    """Sets of two sides, of many sizes, whose words are all frequent, or rare, or both; few shared words a block."""
    monkeypatch.setattr(joins, "OFTEN", often)
    monkeypatch.setattr(joins, "SHARED", 50)
    monkeypatch.setattr(joins, "PAIRS", 7)
    monkeypatch.setattr(joins, "PACK", 30)
    rng = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    chance = [1 / (k + 1) for k in range(300)]
    sets = [sorted({*rng.choices(words, chance, k=rng.randint(1, 60))}) for _ in range(80)]
    sets += [x[: len(x) - k % 3] or x for k, x in enumerate(reversed(sets))]
    sides = np.array([k % 2 for k in range(160)])
    for threshold, side in itertools.product((0.25, 0.3, 0.6), (sides, sides * 0)):
        got = joins._similar(task(sets, side.tolist()), threshold).to_pydict()
        sim = lambda a, b: len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]})
        near = ((a, b) for a in range(160) for b in range(160) if (side[a] < side[b] if side.any() else a < b))
        want = [(a, b, sim(a, b)) for a, b in near if sim(a, b) >= threshold]
        assert sorted(zip(got["ka"], got["kb"], got["sim"], strict=True)) == want and len(want) > 20


def test_only_rows_of_groups_carry_their_texts(spark):
    """Rows are ranked without their texts: these pass no window, and are read for rows of groups only."""
    rows = [(i, i % 4, "s" if i % 4 == 1 else f"s{i % 3}", f"t{i}", "text", i) for i in range(24)] + [(24, 9, None, "n", "text", 24), (25, 9, "s", "n", "text", 25)]
    df = spark.createDataFrame(rows, "id long, leader long, source string, title string, summary string, seq long")
    df = df.withColumns({"source_type": F.lit("editorial"), "url": F.lit("u"), "image_url": F.lit(None).cast("string"), "published_at": F.timestamp_seconds("seq")})
    got = views.assembled(df, tags=F.array(F.lit("ai")))
    assert sorted(([p.id for p in r.perspectives], r.n_sources) for r in got.collect()) == [([20, 16, 12], 3), ([22, 18, 14], 3), ([23, 19, 15], 3)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    passed = plan[plan.index("Window [") :].split("LogicalRDD")[0]
    assert passed.count("Window [") >= 3 and "summary" not in passed and "source" in passed


@pytest.mark.parametrize("group", [None, "day"])
def test_folds_are_streams_in_which_copies_go_by_code(spark, monkeypatch, group):
    """Rows pass a fold in sorted batches, many copies as codes; vectors that are null, odd or no numbers, equal places and groups."""
    monkeypatch.setattr(cluster, "COPIES", 4)
    rng = random.Random(7)
    spots = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(5)] + [[1.0, 2.0], [], None, [float("nan"), 1.0, 0.0, 0.0], [0.1 + 0.2, float("inf"), 0.0, 0.0]]
    vectors = [v and [x + rng.choice([0.0, 0.3]) for x in v] for v in spots * 3]
    rows = [(i, rng.choice([None, [], *([a, b] for a in "abc" for b in "bcd")]), rng.choice(vectors), rng.choice([None, ["P", "q"], ["q", "r", "s"]]), rng.choice(["d", None]), i // 2, i % 3) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>, embedding array<double>, tags array<string>, domain string, seq long, day int").repartition(5)
    item = lambda r: {"tokens": set(r[1] or ()), "embedding": r[2], "tags": r[3], "domain": r[4]}
    parts = [[r for r in rows if group is None or r[6] == day] for day in ({0, 1, 2} if group else [0])]
    want, topics = {}, {}
    for part in parts:
        want |= {r[0]: part[k][0] for r, k in zip(part, cluster.assign(({"tokens": item(r)["tokens"], "embedding": r[2]} for r in part), 0.5, 0.85), strict=True)}
        topics |= {r[0]: (part[k][0], i) for i, (r, k) in enumerate(zip(part, cluster.assign(map(item, part), 0.22, 0.78, 0.25, 0.05, 2), strict=True))}
    got = cluster.near_leaders(df, group=group)
    assert {r.id: r.leader for r in got.collect()} == want and 5 < len({*want.values()}) < 400
    assert "FlatMapGroups" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r.id: (r.leader, r.pos) for r in cluster.topic_leaders(df, group=group, least=1).collect()} == topics
