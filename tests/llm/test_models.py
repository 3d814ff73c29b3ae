"""Katz backoff and the quality classifier against brute force and held-out labels."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import katz, quality
from brindle.llm.queries import QUERIES


def model(docs):
    """Katz's formulas, written out."""
    words = [(i, re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())) + [b""]) for i, t in docs]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c, pairs, follow = collections.Counter(), collections.Counter(), collections.defaultdict(dict)
    for i, w in words:
        if not held(i):
            c.update(w)
            pairs.update(zip([b"", *w], w, strict=False))
    for (h, w), n in pairs.items():
        follow[h][w] = n
    total, k = sum(c.values()), katz.K

    def discounts(values):
        n, d = collections.Counter(values), collections.defaultdict(lambda: 1.0)
        common = (k + 1) * n[k + 1] / n[1] if n[1] else 1
        for r in range(1, k + 1):
            if n[r] and common < 1:
                x = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
                d[r] = x if 0 < x <= 1 else 1.0
        return d

    d1, d2 = discounts(c.values()), discounts(pairs.values())
    left = sum((1 - d1[n]) * n for n in c.values()) / max(1, total)
    scale = 1 if left > 1e-12 else total / (total + 1)
    uni = {w: d1[n] * n / total * scale for w, n in c.items()}
    unknown = left if left > 1e-12 else 1 / (total + 1)

    def p(h, w):
        if h not in follow:
            return uni.get(w, unknown)
        f, n = follow[h], c[h]
        spare = sum((1 - d2[x]) * x for x in f.values()) / n
        s, spare = (1, spare) if spare > 1e-12 else (n / (n + 1), 1 / (n + 1))
        if w in f:
            return d2[f[w]] * f[w] / n * s
        return spare / (1 - sum(uni[x] for x in f)) * uni.get(w, unknown)

    return words, held, c, total, p, follow, uni, unknown


@pytest.mark.parametrize("hot", [False, True])
def test_katz_against_brute_force(spark, sf, monkeypatch, hot):
    monkeypatch.setattr(katz, "CHUNK", 60_000)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(80)
    odd = [(1000, None), (1001, ""), (1002, " \n"), (1003, " End  spaces "), (1004, "the the the THE the"), (None, "x y"), (1004, "the again"), (1005, "É é É")]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string")).select("*", F.lit(1).alias("held_out"), F.lit(1).alias("chunk")).repartition(3)
    if hot:  # contexts above a threshold are dealt out by word as well
        monkeypatch.setattr(katz, "max", lambda *a: 5, raising=False)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    words, held, c, total, p, follow, uni, unknown = model(rows)
    for h in list(follow)[:40]:  # each context sums to one
        assert abs(sum(p(h, w) for w in follow[h]) + sum(p(h, w) for w in uni if w not in follow[h]) + p(h, b"\0new") - 1) < 1e-9
    want = []
    for i, w in words:
        base = sum(math.log10((c[x] + 0.5) / (total + 0.5 * (len(c) + 1))) for x in w)
        want.append((i, held(i), len(w), sum(c[x] > 0 for x in w), total, base, sum(math.log10(p(h, x)) for h, x in zip([b"", *w], w, strict=False))))
    got = katz.scores(docs).collect()
    key = lambda r: (str(r[0]), r[2], r[5])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)
    assert katz.scores(docs.limit(0)).count() == 0


def test_katz_beats_unigrams_on_what_it_did_not_see(spark, sf):
    r = katz.scores(spark.read.parquet(f"{sf}/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_trees_learn_a_rule():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    m = quality.fit(x[:3000], y[:3000])
    assert ((m.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95

    def walk(row):  # plain traversal
        s = m.base
        for f, t, v in zip(m.feature, m.threshold, m.value, strict=True):
            i = 0
            while i < len(f):
                i = 2 * i + 1 + (row[f[i]] > t[i])
            s += v[i - len(f)]
        return 1 / (1 + math.exp(-s))

    assert m.score(x[:20]) == pytest.approx([walk(r) for r in x[:20]])
    assert quality.fit(x[:10], np.ones(10)).score(x[:3]) == pytest.approx([10.5 / 11] * 3)
    assert quality.fit(x[:0], np.ones(0)).score(x[:1]) == pytest.approx([0.5])


def plain_fit(x, y):
    """The trees of fit, by loops over nodes, features and edges."""
    share = (sum(y) + 0.5) / (len(y) + 1)
    margin = [math.log(share / (1 - share))] * len(y)
    edges = [[float(np.quantile([r[j] for r in x], k / quality.BINS)) for k in range(1, quality.BINS)] for j in range(len(x[0]))]
    for _ in range(quality.ROUNDS):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g, h = [a - b for a, b in zip(p, y, strict=True)], [a * (1 - a) for a in p]
        nodes = [list(range(len(y)))]
        for _ in range(quality.DEPTH):
            below = []
            for rows in nodes:
                best, cut = 1e-6, None
                tg, th = sum(g[i] for i in rows), sum(h[i] for i in rows)
                for j in range(len(x[0])):
                    for e in edges[j]:
                        left = [i for i in rows if x[i][j] <= e]
                        lg, lh = sum(g[i] for i in left), sum(h[i] for i in left)
                        if lh >= quality.LEAST_HESSIAN and th - lh >= quality.LEAST_HESSIAN:
                            gain = lg**2 / (lh + quality.L2) + (tg - lg) ** 2 / (th - lh + quality.L2) - tg**2 / (th + quality.L2)
                            if gain > best + 1e-9:
                                best, cut = gain, (j, e)
                below += [rows, []] if cut is None else [[i for i in rows if x[i][cut[0]] <= cut[1]], [i for i in rows if x[i][cut[0]] > cut[1]]]
            nodes = below
        for rows in nodes:
            value = -quality.RATE * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + quality.L2)
            for i in rows:
                margin[i] += value
    return [1 / (1 + math.exp(-m)) for m in margin]


def test_fit_against_plain_loops(monkeypatch):
    for name, value in (("ROUNDS", 3), ("DEPTH", 2), ("BINS", 8)):
        monkeypatch.setattr(quality, name, value)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 4))
    x[:, 3] = x[:, 3].round()
    y = ((x[:, 0] > 0.2) | (x[:, 3] > 0.9)).astype(float)
    assert quality.fit(x, y).score(x) == pytest.approx(plain_fit(x.tolist(), y.tolist()))


def test_quality_query_by_hand(spark, sf):
    """Which rows are learnt from, and scores of all rows, in plain Python."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    own = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.quality is not None and r.doc_id in texts}
    rows = sorted((float(q), quality.statistics(texts[i] or "")) for i, q in own.items())
    key = lambda r: tuple([r[0], *r[1][::-1]])
    rows.sort(key=key)
    x, y = np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
    want = quality.fit(x, y).score(np.array([quality.statistics(t or "") for t in texts.values()]))
    got = {r.doc_id: r for r in QUERIES["op9_quality"](spark, sf).collect()}
    assert set(got) == set(texts)
    for i, s in zip(texts, want, strict=True):
        assert got[i].score == pytest.approx(s, abs=1e-9) and got[i].predicted == int(got[i].score >= 0.7) and got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)


def test_the_model_does_not_depend_on_the_order_of_rows(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.unionByName(docs.withColumn("text", F.reverse("text")))  # repeated doc_ids
    labels = labels.unionByName(labels.limit(20)).unionByName(labels.limit(3).withColumn("quality", 1 - F.col("quality")))
    a, b = quality.learn(docs, labels, 40), quality.learn(docs.repartition(7, F.rand(3)), labels.repartition(5, F.rand(4)), 40)
    assert (a.feature == b.feature).all() and (a.threshold == b.threshold).all() and (a.value == b.value).all()
    with pytest.raises(ValueError):
        quality.classify(docs.withColumn("score", F.lit(1)), labels, keep=("doc_id", "score"))


def test_statistics_of_odd_texts():
    random.seed(1)
    for t in ["", " ", "\n\n", "a", "é" * 10, "x " * 5000, "A!! B!!"]:
        got = quality.statistics(t)
        assert len(got) == len(quality.FEATURES) and all(map(math.isfinite, got))
    assert quality.statistics("") == [0.0] * len(quality.FEATURES)


def test_quality_on_held_out_labels(spark, sf):
    got = QUERIES["op9_quality"](spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) > 0.97 * len(got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_quality_of_odd_tables(spark, sf):
    docs = spark.createDataFrame([(1, None, 0), (1, "", 0), (None, "x", 1), (2, "a b", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (9, None, 0), (2, 1, 0), (7, 0, 1)], "doc_id long, quality int, toxic int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert quality.classify(docs.limit(0), labels).count() == 0 and quality.classify(docs, labels.limit(0)).count() == 4
    assert quality.accepted(docs, labels.limit(0), 0.4).columns == docs.columns


def test_counts_beyond_32_bits():
    """A corpus in which every word stands 2^33 times more often than in this chunk: what the buckets say of words and pairs comes back whole."""
    import pandas as pd
    import pyarrow as pa

    from brindle.llm.common import pack, unpack
    from brindle.llm.stages import join, split

    more = 1 << 33
    docs = pa.array(["a b a b c", "b a"])
    words = katz.chunk_words(pa.array([1, 2]), pa.array([False, False]), docs, 1)
    sent = pd.DataFrame([(0, kind, bucket, data if kind == katz.DOCS else join(split(data)[0], pack(unpack(split(data)[1]) + more))) for kind, bucket, data in words], columns=["chunk", "kind", "bucket", "data"])
    replies = katz.bucket_words(sent[sent["kind"] == katz.WORDS])
    rows = pd.concat([sent, replies])
    start = np.zeros(1, np.int64)
    chunk = katz.Chunk(rows, start)
    assert sorted(chunk.count.tolist()) == [more + 1, more + 2, more + 3, more + 3]  # c, the end, a and b
    pairs = katz.chunk_pairs(rows, start, 1, 1 << 60)
    key, count, after, contexts = map(unpack, split(pairs["data"].iloc[0]))
    assert after.min() > more and contexts.min() > more and len(contexts) == 4
    pairs["data"] = [join(pack(key, delta=True), pack(count.astype(np.int64) + more), pack(after), pack(contexts))]
    whole = unpack(split(replies.loc[replies["kind"] == katz.UNIGRAMS, "data"].iloc[0])[1])
    n = np.bincount(np.full(len(whole), katz.K + 2), minlength=katz.K + 3)
    unigrams = katz.Unigrams(n, int(whole.sum()), len(whole))
    out = katz.bucket_pairs(pairs, unigrams, more)  # all contexts are hot
    total, *seen, mass = map(unpack, split(out.loc[out["kind"] == katz.PAIR_REPLY, "data"].iloc[0]))
    assert (total == count.astype(np.int64) + more).all()
    assert sum(s.sum() for s in seen) == total.sum() and seen[-1].min() > more
    context, *stats, _ = map(unpack, split(out.loc[out["kind"] == katz.HOT, "data"].iloc[0]))
    assert len(context) == 4 and sum(s.sum() for s in stats) == total.sum()
    assert (unpack(split(out.loc[out["kind"] == katz.BIGRAMS, "data"].iloc[0])[1]) == total).all()
    want = [sum(whole[w] for w in key[key >> 32 == h] & 0xFFFFFFFF) / whole.sum() for h in np.unique(key >> 32)]
    assert np.allclose(mass, want)
