"""Vector codes, the filter audit and the URL filter against plain loops."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from brindle.llm import filteraudit, urlfilter, veccodes


def test_nearest_is_exact_where_single_precision_is_not():
    rng = np.random.default_rng(1)
    for s, most in ((4, 300), (4, 1 << 22), (33, 1 << 22), (1, 3), (0, 1)):
        parts, entries = (rng.integers(-most, most + 1, (n, s)) for n in (5000, 64))
        entries[40] = entries[7]  # a tie
        parts[:500] = entries[rng.integers(0, 64, 500)] + rng.integers(-1, 2, (500, s))
        entries[1:9] = entries[9] + rng.integers(-1, 2, (8, s))  # closer together than a rounding error
        index, error = veccodes.nearest(parts, entries)
        every = ((parts[:, None] - entries) ** 2).sum(2)
        assert (error == every.min(1)).all() and (index == every.argmin(1)).all()


def plain_codes(rows):
    """rows (vec_id, label, vector) -> {vec_id: (code, error, label_error, digest)}, by the definition."""
    kept = sorted(((i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0], r[2]))
    coded, books = [], {}
    for size in {len(v) for _, _, v in kept}:
        own = [(i, label, v + [0] * (-size % 16)) for i, label, v in kept if len(v) == size]
        s = -(-size // 16)
        part = lambda v, k: v[k * s : (k + 1) * s]
        book = [[part(v, k) for _, _, v in own[:64]] for k in range(16)]
        best = lambda p, entries: min((sum((a - b) ** 2 for a, b in zip(p, e, strict=True)), j) for j, e in enumerate(entries))
        for _ in range(2):
            for k in range(16):
                to = collections.defaultdict(list)
                for _, _, v in own:
                    to[best(part(v, k), book[k])[1]].append(part(v, k))
                book[k] = [[sum(c) // len(to[j]) for c in zip(*to[j], strict=True)] if j in to else e for j, e in enumerate(book[k])]
        books[size] = hashlib.sha256(",".join(str(x) for entries in book for e in entries for x in e).encode()).hexdigest()
        for i, label, v in own:
            found = [best(part(v, k), book[k]) for k in range(16)]
            coded.append((i, label, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found), books[size]))
    errors = collections.Counter()
    for _, label, _, e, _ in coded:
        errors[label] += e
    return sorted((str(i), c, e, errors[label], b) for i, label, c, e, b in coded)


def codes(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>, code string, error string").withColumn("size", F.lit(1)).withColumn("a.b", F.lit(1))
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in veccodes.compress(df).collect())


def test_codes_of_odd_vectors(spark):
    rng = random.Random(2)
    vec = lambda n: [float(np.float32(rng.gauss(0, 0.3))) for _ in range(n)]
    rows = [(i, rng.choice([0, 1, None]), vec(32)) for i in range(300, 100, -1)]
    rows += [(i, 1, v) for i, (_, _, v) in enumerate(rows[:80], 400)]  # copies
    rows += [(7, None, None), (8, 1, [1.0] * 31 + [None]), (9, 1, [math.nan] * 32), (10, 2, [math.inf] + [0.0] * 31), (11, 2, [-0.0] * 32), (12, 3, []), (None, 0, vec(32)), (13, 4, vec(5)), (14, 4, vec(5)), (101, 5, vec(32))]
    rows = [(*r, "x", "y") for r in rows]
    rng.shuffle(rows)
    got = codes(spark, rows)
    assert got == plain_codes([r[:3] for r in rows]) and len(got) == len(rows) - 4
    assert codes(spark, []) == []
    assert codes(spark, [(1, 1, [3e38] * 16, "", "")])[0][2] == 0  # counted as the bound


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_audit(docs, labels):
    least, tests = {}, []
    for i, _, t in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = ({i for i, *x in labels if x[k] == 1} for k in (0, 1))
    for i, lang, t in docs:
        t = t or ""
        w = WORD.findall(t)
        fails = {c for c, bad in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > least[t]), strict=True) if bad}
        tests.append((lang or "", fails, i is not None and i in good, i is not None and i in toxic))
    out = {}
    for part in {p for p, *_ in tests}:
        own, shapley = [x[1:] for x in tests if x[0] == part], collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, f in enumerate(order):
                gone = lambda x: x[0] & set(order[:k])  # noqa: B023, E731
                now = [x for x in own if f in x[0] and not gone(x)]
                shapley[f] += len(now)
                out[part, order, k + 1] = [sum(not gone(x) and f not in x[0] for x in own), len(now), sum(f in x[0] and bool(gone(x)) for x in own), sum(x[0] == {f} for x in own), sum(x[1] for x in now), sum(x[2] for x in now)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def audited(spark, docs, labels):
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string").withColumn("mask", F.lit("x")).withColumn("a.b", F.lit(1)).repartition(6)
    got = filteraudit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("n", F.lit(1))).collect()
    return {(r.part, r.filter_order, r.step): list(r[3:]) for r in got}


def test_audit_of_odd_documents(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "A" * 50, "é" * 300_000, "# x", "a\x0bb\x85c d", "\x1c A"] + [" ".join(rng.choice(["ab", "Cd", "e&", "ö", "f", str(k)]) for k in range(rng.choice([20, 199, 200, 400]))) for _ in range(12)]
    docs = [(rng.choice([None, *range(40)]), rng.choice(["en", "de", "", None]), rng.choice(texts)) for _ in range(400)] + [(1000 + k, "en", texts[8]) for k in range(300)]
    docs += [(1, "de", texts[8]), (1, "en", texts[8]), (1, None, texts[8])]
    labels = [(rng.choice([None, *range(40), *range(1000, 1200)]), rng.choice([0, 1, None]), rng.choice([0, 1])) for _ in range(300)]
    got = audited(spark, docs, labels)
    assert got == plain_audit(docs, labels) and len(got) == 3 * 600
    assert audited(spark, [], labels) == {} and audited(spark, docs, []) == plain_audit(docs, [])


def test_texts_of_one_fingerprint_stay_apart():
    c = filteraudit.Chains()
    assert c.add(5, 9, "en", 1, 0, b"one") == () and c.add(5, 4, "en", 1, 0, b"two") == ()
    assert c.add(5, 7, "de", 1, 0, b"one") == ((9, "en", 1, filteraudit.COPY),) and c.add(5, 8, "en", 1, 0, b"one") == ((8, "en", 1, filteraudit.COPY),)
    assert [x[1] for x in c.least()] == [7, 4]


def test_a_task_passes_on_what_it_can_not_hold(spark, monkeypatch):
    monkeypatch.setattr(filteraudit, "HELD", 1000)
    monkeypatch.setattr(filteraudit, "TASKS", 2)
    docs = [(k, "en", f"text {k % 50} " * 20) for k in range(3000)]
    assert audited(spark, docs, []) == plain_audit(docs, [])


URLS = [
    "https://a.com/x", "http://EXAMPLE.com/en/1", "http://www.example.com/en/1", "http://m.example.com/en/", "http://example.com/en", "https://b.net/es/1?x=1&y=2#top", "https://b.net/de/1", "b.net/es/", None, "", "://", "x://net/fr/9", "http://com", "http://com?x=/", "http://notcom/",
    "http://u@Y.COM:80/p", "http://y.com:80", "a://b://c.com/en/", "http://É.COM/ÉN/", "http://example.com/EN/", "http://x.com/\nnew?a&&b", "http://" + "y" * 100_000 + ".net/" + "es/" * 1000,
]


def plain_rule(url):
    if not url or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    raw = re.match("[^/?#]*", rest)[0]
    host, path = re.sub("[A-Z]", lambda m: m[0].lower(), raw), re.match("[^?#]*", rest[len(raw) :])[0]
    fit = [r for r in urlfilter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.host + r.path), default=None)
    return host, path, best and best.host + best.path, best and best.verdict


def test_rules_of_odd_urls(spark):
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(URLS)] + [(None, "http://q.com/", "y")], "page_id long, url string, host string").withColumn("a.b", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages).collect()}
    for k, url in enumerate(URLS):
        want = plain_rule(url)
        assert got[k][:3] == want[:3] and got[k][3] in ([want[3]] if want[3] else ["allow", "block"])
    assert got[None][2] == "com/" and len(got) == len(URLS) + 1
    assert urlfilter.judge(pages.limit(0)).collect() == []


def plain_features(url, host, path, of):
    q = re.match(r"(?s)[^?#]*\?([^#]*)", url)
    n = len(url)
    bits = -sum(c / n * math.log2(c / n) for c in collections.Counter(url).values()) if n else 0
    return [n, len(host), len([x for x in path.split("/") if x]), sum(c in "0123456789" for c in url) / max(1, n), bits, len([x for x in q[1].split("&") if x]) if q else 0, *of[host.split(".")[-1].split(":")[0]]]


def plain_trees(x, y):
    """Boosting with the module's constants, a loop at a time."""
    u = urlfilter
    weight = [len(y) / (2 * sum(y)) if b else len(y) / (2 * (len(y) - sum(y))) for b in y]
    margin = [0.0] * len(y)
    edges = [sorted(set(np.percentile(x[:, f], [100 * k / u.BINS for k in range(1, u.BINS)]).tolist())) for f in range(x.shape[1])]
    for _ in range(u.ROUNDS):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g, h = [round((a - b) * w * u.UNIT) / u.UNIT for a, b, w in zip(p, y, weight, strict=True)], [round(a * (1 - a) * w * u.UNIT) / u.UNIT for a, w in zip(p, weight, strict=True)]

        def grow(rows, level):
            tg, th = sum(g[i] for i in rows), sum(h[i] for i in rows)
            best = (1e-6,)
            for f in range(x.shape[1]) if level < u.DEPTH else ():
                for k, e in enumerate(edges[f]):
                    left = [i for i in rows if x[i, f] <= e]
                    lg, lh = sum(g[i] for i in left), sum(h[i] for i in left)
                    if lh >= u.LEAST_HESSIAN and th - lh >= u.LEAST_HESSIAN:
                        gain = lg**2 / (lh + u.L2) + (tg - lg) ** 2 / (th - lh + u.L2) - tg**2 / (th + u.L2)
                        best = max(best, (gain, -f, -k, e, left))
            if len(best) == 1:
                for i in rows:
                    margin[i] -= u.RATE * tg / (th + u.L2)
            else:
                left = set(best[4])
                grow(best[4], level + 1)
                grow([i for i in rows if i not in left], level + 1)

        grow(list(range(len(y))), 0)
    return [1 / (1 + math.exp(-m)) for m in margin]


def made_urls(rng, n):
    """Long ones with digits and parameters are bad; two hosts are known to the rules."""
    for k in range(n):
        bad = rng.random() < 0.4
        tail = f"{rng.randrange(10**9)}?id={rng.randrange(10**6)}&s={rng.randrange(99)}" if bad else "/".join(rng.choices(["news", "world", "tech", "art"], k=rng.randrange(1, 4)))
        yield k, bad, f"http://{rng.choice(['known.', 'other.'])}{'bad' if bad and k % 2 else rng.choice(['good', 'site'])}.{rng.choice(['org', 'info'])}/{tail}"


def test_trees_equal_plain_boosting_and_hold_out(spark):
    rows = list(made_urls(random.Random(4), 900))
    host = lambda u: u.split("/")[2]
    pages = spark.createDataFrame([(k, u) for k, _, u in rows], "page_id long, url string")
    labelled = {k: b for k, b, u in rows if host(u).startswith("known.")}
    parts = urlfilter.parted(pages)
    of = urlfilter.suffixes(parts)
    y = F.array_contains(F.array(*(F.lit(k) for k, b in labelled.items() if b)), F.col("page_id")).cast("int")
    known = urlfilter.with_features(parts, of).where(F.col("host").startswith("known.")).select("page_id", y.alias("y"), "x").cache()
    model = urlfilter.fit(known)
    got = {r.page_id: (r.y, r.x, r.s) for r in known.withColumn("s", model.score(F.col("x"))).collect()}
    stats = {}
    for suffix in ("org", "info"):
        own = [u for _, _, u in rows if host(u).endswith(suffix)]
        depth = [len([p for p in plain_rule(u)[1].split("/") if p]) for u in own]
        chars = sum(map(len, own))
        stats[suffix] = (math.log2(len(own)), chars / len(own), sum(depth) / len(own), sum(c.isdigit() for u in own for c in u) / chars)
    urls = {k: u for k, _, u in rows}
    x = np.array([plain_features(urls[k], *plain_rule(urls[k])[:2], stats) for k in got])
    assert np.allclose(x, np.array([v[1] for v in got.values()]), atol=1e-12)
    want = plain_trees(np.array([v[1] for v in got.values()]), [v[0] for v in got.values()])
    assert np.allclose([v[2] for v in got.values()], want, atol=1e-6)
    scored = urlfilter.with_features(parts, of).where(~F.col("host").startswith("known.")).select("page_id", model.score(F.col("x")).alias("s")).collect()
    bad = {k: b for k, b, _ in rows}
    assert sum((r.s >= 0.5) == bad[r.page_id] for r in scored) > 0.97 * len(scored) > 300


def test_learning_is_from_what_rules_decide(spark):
    rows = list(made_urls(random.Random(5), 600))
    clean = [urlfilter.Rule(f"known.{h}.{t}", f"/{p}", "allow") for h in ("good", "site") for t in ("org", "info") for p in ("news", "world", "tech", "art")]
    rules = (urlfilter.Rule("known.bad.org", "/", "block"), urlfilter.Rule("known.bad.info", "/", "block"), *clean)
    got = urlfilter.judge(spark.createDataFrame([(k, u) for k, _, u in rows], "page_id long, url string"), rules).collect()
    bad = {k: b for k, b, _ in rows}
    open_ = [r for r in got if r.rule is None]
    assert sum((r.verdict == "block") == bad[r.page_id] for r in open_) > 0.9 * len(open_) > 200
    assert all((r.score is None) == (r.rule is not None) for r in got)
    plan = urlfilter.judge(spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
