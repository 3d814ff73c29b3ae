"""Near-duplicates, repeated strings, leaks and archives against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from brindle.llm import components, decontam, esais, sadedup, simhash, vecdup, warc


class Union(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def test_components(spark):
    random.seed(1)
    edges = [(random.randint(0, 300), random.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1030)] + [(5000, i) for i in range(5001, 5200)] + [(7, 7)]
    u = Union()
    for a, b in edges:
        if a != b:
            u.join(a, b)
    got = {r.node: r.component for r in components.components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    assert got == {x: u.find(x) for x in u}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def fingerprint(text, k):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    s = [b" ".join(w[j : j + k]) for j in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum((2 * sum(x >> j & 1 for x in h) > len(h)) << j for j in range(64)), set(h)


def near_copies(n):
    random.seed(2)
    words = [f"w{i}" for i in range(400)]
    base = random.choices(words, k=60)
    out = [" ".join(base)] * 3
    for _ in range(n):
        copy = list(base)
        for _ in range(random.randint(1, 6)):
            copy[random.randrange(60)] = random.choice(words)
        out.append(" ".join(copy))
    return out + [" ".join(random.choices(words, k=random.randint(0, 9))) for _ in range(30)] + [None, "", " ", "A b", "a B", "a  b\n"]


def clashing(df):
    return df.select("*", F.lit(1).alias("fp"), F.lit("x").alias("fingerprint"), F.lit(2).alias("key"), F.lit(3).alias("a"))


@pytest.mark.parametrize("shard", [2048, 4])
def test_simhash_groups(spark, monkeypatch, shard):
    monkeypatch.setattr(simhash, "SHARD", shard)
    monkeypatch.setattr(simhash.links, "__defaults__", (shard,))
    texts = near_copies(80)
    docs = clashing(spark.createDataFrame([*enumerate(texts), (3, texts[3]), (None, "null id")], "doc_id long, text string"))
    fp = {i: fingerprint(t or "", 3)[0] for i, t in enumerate(texts)}
    u = Union()
    for i in fp:
        u.find(i)
        for j in fp:
            if (fp[i] ^ fp[j]).bit_count() <= 2:
                u.join(i, j)
    got = simhash.near_duplicates(docs, 3, 2).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        if r.doc_id is not None:
            assert (r.fingerprint, r.component_id) == (f"{fp[r.doc_id]:016x}", u.find(r.doc_id))
    assert simhash.near_duplicates(docs.limit(0), 3, 2).count() == 0


@pytest.mark.parametrize("tile", [1024, 5])
def test_similar_groups(spark, tile):
    texts = near_copies(80)
    docs = clashing(spark.createDataFrame([*enumerate(texts), (3, texts[3]), (None, texts[0])], "doc_id long, text string"))
    sets = {i: fingerprint(t or "", 5)[1] for i, t in enumerate(texts)}
    u, linked = Union(), 0
    for i in sets:
        u.find(i)
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and (sets[i] == sets[j] or both >= 0.8 * (len(sets[i]) + len(sets[j]) - both)):
                linked += 1
                u.join(i, j)
    assert linked > 50
    got = simhash.similar_groups(docs, tile=tile).collect()
    assert len(got) == len(texts) + 2 and all(r.component_id == (None if r.doc_id is None else u.find(r.doc_id)) for r in got)
    assert simhash.similar_groups(docs.limit(0)).count() == 0


def test_similar_links_counts_every_pair(monkeypatch):
    rng = np.random.default_rng(8)
    for common, cells in ((32, 1 << 22), (2, 64)):  # by pairs of places, and by products of blocks of the matrix
        monkeypatch.setattr(simhash, "RARE", common)
        monkeypatch.setattr(simhash, "CELLS", cells)
        base = rng.integers(0, 1 << 40, (4, 60), dtype=np.uint64)
        sets = [np.unique(np.concatenate((rng.choice(base[i % 4], 50 + i % 11, False), rng.integers(0, 1 << 40, i % 5, dtype=np.uint64)))) for i in range(50)]
        for tiles in ([0] * 50, [i // 4 % 2 for i in range(50)]):
            u = Union({i: i for i in range(50)})
            for i in range(50):
                for j in range(i):
                    both = len(np.intersect1d(sets[i], sets[j]))
                    if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) and (tiles[i] != tiles[j] or not any(tiles)):
                        u.join(i, j)
            v = Union({i: i for i in range(50)})
            for a, b in simhash.similar_links(list(range(50)), sets, tiles, 0.8):
                v.join(a, b)
            assert [u.find(i) for i in range(50)] == [v.find(i) for i in range(50)] and len({u.find(i) for i in range(50)}) < 40


def test_recall_of_similar_groups_on_a_whole_table(spark):
    """Links of all pairs of 1,000 documents, by an inverted index: at least 0.99 are in one group, and no group is joined by anything else."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r.doc_id: fingerprint(r.text or "", 5)[1] for r in docs.collect()}
    holders, both = collections.defaultdict(list), collections.Counter()
    for i in sorted(sets):
        for x in sets[i]:
            holders[x].append(i)
    for h in holders.values():
        both.update((a, b) for k, a in enumerate(h) for b in h[k + 1 :])
    links = [(a, b) for (a, b), n in both.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    empty = [i for i in sorted(sets) if not sets[i]]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    u = Union()
    for a, b in [*links, *zip(empty, empty[1:], strict=False)]:
        u.join(a, b)
    recall = sum(got[a] == got[b] for a, b in links) / len(links)
    assert len(links) > 100 and recall >= 0.99
    assert all(u.find(i) == u.find(got[i]) for i in sets)


def test_similar_groups_with_a_repeated_line(spark):
    rng = random.Random(11)
    texts = []
    for k, times in enumerate((1, 20, 40, 80)):
        words = [f"w{k}x{i}" for i in rng.sample(range(10_000), 300)]
        line = [f"f{k}x{i}" for i in range(8)]
        texts += [" ".join([*words, *line]), " ".join([*words, *line * times])]
    far = [(fingerprint(a, 5)[0] ^ fingerprint(b, 5)[0]).bit_count() for a, b in zip(texts[::2], texts[1::2], strict=True)]
    assert max(far) > 22
    got = simhash.similar_groups(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(i, i - i % 2) for i in range(8)]


def test_similar_groups_of_an_id_with_two_texts(spark):
    rng = random.Random(12)
    texts = [[f"w{k}x{i}" for i in range(200)] for k in range(2)]
    near = [[*t[:199], "else"] for t in texts]
    rows = [(1, texts[0]), (1, texts[1]), (5, near[0]), (6, near[1])]
    rng.shuffle(rows)
    got = simhash.similar_groups(spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (5, 1), (6, 1)]


def test_bk_tree():
    random.seed(3)
    items = [random.getrandbits(12) for _ in range(200)]
    t = simhash.BKTree()
    for x in items:
        t.add(x)
    for x in random.choices(range(4096), k=100):
        assert sorted(t.within(x, 2)) == [i for i, y in enumerate(items) if (x ^ y).bit_count() <= 2]


def brute_suffixes(text):
    ranks, z = [], 0
    for x in text:
        ranks.append(x if x else z - 10**6)
        z += x == 0
    order = sorted(range(len(text)), key=lambda i: ranks[i:])
    common = [0]
    for a, b in zip(order, order[1:], strict=False):
        h = 0
        while max(a, b) + h < len(text) and ranks[a + h] == ranks[b + h]:
            h += 1
        common.append(h)
    return order, common


def test_suffix_arrays(monkeypatch):
    random.seed(4)
    for _ in range(150):
        k = random.randint(1, 4)
        text = [x for _ in range(random.randint(1, 5)) for x in [*random.choices(range(1, k + 1), k=random.randint(0, 15)), 0]]
        want = brute_suffixes(text)
        for piece, small, memory in ((1024, 64, 1 << 20), (1024, 0, 1 << 20), (4, 0, 64), (2, 3, 64), (1, 0, 64)):
            monkeypatch.setattr(esais, "LEAST_PIECE", piece)
            monkeypatch.setattr(esais, "PIECE_SHARE", 0)
            order, common = esais.suffixes(np.array(text, np.uint16), memory, small)
            assert (order.tolist(), common.tolist()) == want
            assert esais.order_of(np.array(text, np.int32), memory, small).tolist() == want[0]


def test_suffix_arrays_spill(monkeypatch):
    spilled = []
    close = esais.DiskQueues.close
    monkeypatch.setattr(esais.DiskQueues, "close", lambda q: (spilled.append(q.spilled), close(q)))
    random.seed(5)
    text = np.array([random.choice([1, 2, 3, 3, 0]) for _ in range(20_000)] + [0], np.uint16)
    a, b = esais.suffixes(text, 1 << 12, 4), esais.suffixes(text, 1 << 30, 10**9)
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all() and max(spilled) > 10_000


def test_suffixes_of_a_shard_of_ten_times_the_memory(tmp_path):
    """Memory is a tenth of the text's; recursion goes on until few symbols are left."""
    import tracemalloc

    rng = np.random.default_rng(9)
    n = 1_000_000
    words = rng.integers(1, 30, (4000, 25))
    text = np.memmap(tmp_path / "text", np.uint16, "w+", shape=(n,))
    text[:] = words[rng.integers(0, 4000, n // 25)].ravel()
    text[79::80] = 0
    text[-1] = 0
    peaks, memory, levels = [], n * 2 // 10, []
    for x, m, small in ((np.array(text), 1 << 30, 10**9), (text, memory, 2000)):
        tracemalloc.start()
        order, common = esais.suffixes(x, m, small, levels if x is text else None)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        want = want if x is text else (order, common)
    assert len(levels) > 3 and all(b < 0.5 * a for a, b in zip(levels, levels[1:], strict=False))
    assert isinstance(order, np.memmap) and peaks[1] < 4 << 20 and 8 * peaks[1] < peaks[0]
    assert (order == want[0]).all() and (common == want[1]).all()


@pytest.mark.parametrize("hot", [10_000, 3])
def test_repeated_strings(spark, sf, monkeypatch, hot):
    monkeypatch.setattr(sadedup, "CHUNK", 50_000)
    monkeypatch.setattr(sadedup, "HOT", hot)
    monkeypatch.setattr(sadedup, "max", lambda *a: hot if a[0] == hot else max(*a), raising=False)
    monkeypatch.setattr(sadedup, "STEP", 7_000)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(70)
    odd = [(5000, "a" * 500), (5001, "a" * 120), (5002, None), (5003, ""), (5004, "ñ" * 80), (5005, "x" + "ñ" * 80), (5000, "a" * 500), (None, "a" * 60), (None, "b" * 60), (5006, "ab" * 100), (5007, "x" * 49)]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string")).select("*", F.lit(7).alias("n_bytes"), F.lit("q").alias("_text")).repartition(3)
    rows = [(10**15 if r.doc_id is None else r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    first = {}
    for i, b in rows:
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            first[w] = min(i, first.get(w, i))
    want = []
    for i, b in rows:
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want.append((None if i == 10**15 else i, len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    assert sum(w[2] for w in want) > 500
    assert sorted(map(tuple, sadedup.dedup(docs).collect()), key=str) == sorted(want, key=str)
    out = sadedup.dedup(docs, keep=("n_bytes", "_text"), with_text=True).collect()
    assert all(r.row.n_bytes == 7 and r.row._text == "q" for r in out)
    assert all(hashlib.sha256((r.text or "").encode()).hexdigest() == r.kept_sha256 for r in out if "ñ" not in (r.text or ""))
    assert [r.text for r in out if r.doc_id == 5002] == [None]
    assert sadedup.dedup(docs.limit(0)).count() == 0


def test_vectors(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(6, 16))
    v = [(base[rng.integers(6)] + rng.normal(size=16) * rng.choice([0, 0.05, 0.3, 2])).tolist() for _ in range(150)]
    rows = [(i, x, int(rng.integers(3))) for i, x in enumerate(v)] + [(200 + i, v[0], 1) for i in range(5)]
    rows += [(300, None, 1), (301, [], 1), (302, [0.0] * 16, 1), (303, [1.0, None], 1), (304, [float("nan")] * 16, 1), (305, [float("inf")] + [1.0] * 15, 1), (306, v[0], None), (307, v[0][:8], 1), (308, [2 * x for x in v[0]], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").select("*", F.lit(1).alias("n"), F.lit(1).alias("cid"))
    good = [(i, np.array(x), c) for i, x, c in rows if x and c is not None and None not in x and np.isfinite(x).all() and np.any(x)]
    u, n = Union(), collections.Counter()
    for i, x, c in good:
        for j, y, d in good:
            if i != j and c == d and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.93:
                n[i] += 1
                u.join(i, j)
    want = sorted((i, n[i], u.find(i), u.find(i) == i) for i, _, _ in rows)
    for tile in (1024, 7):
        monkeypatch.setattr(vecdup.class_links, "__defaults__", (tile,))
        assert sorted(map(tuple, vecdup.near_duplicates(df).collect())) == want
    assert sum(n.values()) > 200 and vecdup.near_duplicates(df.limit(0)).count() == 0


def test_quantisation_bounds_hold():
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=(200, 1500)), rng.normal(size=(210, 1500))
    b[:50] = a[:50] + rng.normal(size=(50, 1500)) * 0.35
    i, j, sure = map(np.concatenate, zip(*vecdup.decided(vecdup.quantise(a), vecdup.quantise(b), 0.93), strict=True))
    yes = vecdup.exact(a, b, i, j, 0.93)
    assert yes[sure].all() and sure.any() and not sure.all()  # the bounds decide some pairs, and never wrongly
    i, j = i[yes], j[yes]
    cos = (a @ b.T) / np.linalg.norm(a, axis=1)[:, None] / np.linalg.norm(b, axis=1)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted(map(tuple, np.argwhere(cos >= 0.93).tolist())) and len(i)


def greedy(p, t, k):
    """Greedy string tiling as it is defined: all longest matches of unmarked tokens, again and again."""
    mp, mt, tiles = set(), set(), []
    while True:
        best, found = k, []
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and i + n not in mp and j + n not in mt:
                    n += 1
                if n > best:
                    best, found = n, [(i, j)]
                elif n == best:
                    found.append((i, j))
        if not found:
            return tiles
        for i, j in found:
            if not (mp & {*range(i, i + best)} or mt & {*range(j, j + best)}):
                mp |= {*range(i, i + best)}
                mt |= {*range(j, j + best)}
                tiles.append((i, j, best))


def test_tiles_are_greedy_string_tiling():
    random.seed(8)
    for _ in range(300):
        p, t = ([random.choice("abc") for _ in range(random.randint(0, 25))] for _ in range(2))
        items = decontam.Items([(1, p)], 3)
        ids = np.array([items.vocabulary.get(w, -1) for w in t], np.int64)
        assert sorted(decontam.tile(items.matches(ids).get(0, []), 3)) == sorted(greedy(p, t, 3))


def leaked(text, items, coverage=0.5):
    """n_items, item_id and coverage by the definition."""
    count, best = 0, (0.0, 0, None)
    for i, x in items:
        x = (x or "").split()
        if i is not None and len(x) >= 3:
            covered = sum(n for _, _, n in greedy(x, (text or "").lower().split(), min(5, len(x)))) / len(x)
            count += covered >= coverage
            best = max(best, (covered, -i, i) if covered else best, key=lambda y: y[:2])
    return count, best[2], pytest.approx(best[0]), count > 0


@pytest.mark.parametrize("block", [10**6, 30])
def test_contamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "CHAIN", 3)
    monkeypatch.setattr(decontam, "PAIRS", 7)
    random.seed(9)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(random.choices(words, k=random.randint(3, 40)))) for i in range(12)] + [(90, None), (91, ""), (92, "w1 w2"), (None, "a b c d e f g"), (0, "s t u v"), (95, "s t u v")]
    halves = lambda t: " ".join(reversed([" ".join(x) for x in (t.split()[:15], t.split()[15:])]))
    docs = [(i, " ".join(random.choices(words, k=50) + [random.choice([items[i % 12][1], halves(items[i % 12][1]), " ".join(items[i % 12][1].split()[:6]), ""]).upper()] + random.choices(words, k=50))) for i in range(40)]
    docs += [(50, None), (51, ""), (None, items[0][1]), (None, items[0][1]), (None, "x"), (7, items[1][1]), (7, "y"), (7, items[1][1]), (60, "a s t u v b"), (61, "s t u"), (62, "w1 w2")]
    want = [(d, *leaked(t, items)) for d, t in docs]
    df = spark.createDataFrame(docs, "doc_id long, text string").select("*", F.lit(1).alias("coverage"), F.lit("y").alias("_words"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(df, bench, block=block).collect()
    key = lambda r: (str(r[0]), r[1], str(r[2]))
    assert [tuple(r) for r in sorted(got, key=key)] == sorted(want, key=key)
    assert 5 < sum(w[1] > 0 for w in want) < 40
    assert sorted(str(r.doc_id) for r in decontam.clean(df, bench, block=block).collect()) == sorted(str(w[0]) for w in want if not w[1])
    assert decontam.clean(df, bench).columns == df.columns
    assert decontam.contamination(df.limit(0), bench).count() == 0 and decontam.contamination(df, bench.limit(0)).where("contaminated").count() == 0


def test_tokens_of_unspaced_scripts():
    assert decontam.tokens("Ab_1 \u65e5\u672c\u8a9ex \u0e01\u0e02!") == ["ab_1", "\u65e5", "\u672c", "\u8a9e", "x", "\u0e01", "\u0e02"]


def test_tiling_of_a_word_that_is_repeated_a_hundred_thousand_times():
    import resource

    items = decontam.Items([(1, ["a"] * 100), (2, ["a"] * 60 + [f"u{i}" for i in range(200)])], 5)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert items.leaks("a " * 100_000, 0.5) == (1, 1, 1.0)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000  # KB


def test_warc(spark):
    big, small = "<p>é</p>" * 200, "tiny"
    rows = [(1, "http://a/ b", big), (5, "http://b", big), (3, None, big), (7, "http://c", small), (8, "http://d", small), (9, "http://e", None), (10, "http://f", "\r\n\r\nWARC/1.1\r\n\n" * 100), (None, "http://g", "x" * 2000), (11, "http://h", "y" * 999), (12, "http://i", "y" * 999)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", F.lit(1).alias("key"), F.lit(2).alias("kept"))
    got = sorted(map(tuple, warc.converted(df).collect()), key=str)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        same = [j for j, _, x in rows if x == h and len(b) >= 1000 and j is not None]
        ref = max(same) if same and max(same) != i else None
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if ref is not None else "response", ref))
    assert got == sorted(want, key=str)
    assert warc.converted(df.limit(0)).count() == 0


def test_warc_files(spark, tmp_path):
    """Each reference names a record, identifiers are unique, gzip's own reader takes the files, and their size is bounded."""
    import gzip

    rng = random.Random(3)
    noise = lambda n: "".join(rng.choices("0123456789abcdefghijklmnopqrstuvwxyz", k=n))
    same, long = noise(5000), noise(20 << 20)  # a page longer than two members and than a file
    rows = [(i, f"http://h/{i}", same if i % 3 else noise(2000)) for i in range(60)] + [(100, "http://h/long", long), (101, "http://h/too", long), (102, "ftp://h/x", "z" * 50)]
    warc.write(warc.with_targets(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1)), path := str(tmp_path / "out"), 40_000)
    files = [p.read_bytes() for p in (tmp_path / "out").glob("part-*") if p.stat().st_size]
    assert sum(len(f) > 40_000 for f in files) == 1 and len(files) > 3
    records = [(h, b) for f in files for h, b in warc.read_warc(f)]
    assert all(next(warc.read_warc(f))[0]["warc-type"] == "warcinfo" for f in files)
    assert all(len([*warc.read_warc(gzip.decompress(f))]) == len([*warc.read_warc(f)]) for f in files)
    ids = {h["warc-record-id"]: h for h, _ in records}
    assert len(ids) == len(records) == len(rows) + len(files)
    kinds = collections.Counter(h["warc-type"] for h, _ in records)
    assert kinds["revisit"] == 40 and kinds["resource"] == 1 and kinds["response"] == 22
    for h, b in records:
        assert len(b) == int(h["content-length"])
        if h["warc-type"] == "revisit":
            to = ids[h["warc-refers-to"]]
            assert to["warc-type"] == "response" and to["warc-payload-digest"] == h["warc-payload-digest"] and (to["warc-target-uri"], to["warc-date"]) == (h["warc-refers-to-target-uri"], h["warc-refers-to-date"])
        if h["warc-type"] == "response":
            assert b.startswith(b"HTTP/1.1 200 ") and h["content-type"] == "application/http; msgtype=response" and hashlib.sha1(warc.payload(h, b)).hexdigest() == h["warc-payload-digest"][5:]
        if "warc-block-digest" in h:
            assert hashlib.sha1(b).hexdigest() == h["warc-block-digest"][5:]
    assert sorted((r.page_id, r.payload_bytes) for r in warc.read(spark, path).collect()) == [(i, len(t)) for i, _, t in rows]
    for f in files:
        for bad in (f[:-1], f[: len(f) // 2]):
            with pytest.raises(ValueError):
                list(warc.read_warc(bad))


@pytest.mark.parametrize("version", [1, 2])
def test_arc_lines_and_lengths(version):
    rows = [("http://a", "20010203040506", "text/html", b"a\nb\n"), ("dns:b", "20010203040507", "image/png", b""), ("http://c d", "20010203040508", "text/plain", b"x" * 99)]
    archive = warc.arc_bytes(rows, version, "n.arc")
    got = list(warc.read_arc(archive))
    assert [(r.url, r.date, r.kind, r.payload) for r in got] == [(u.replace(" ", "%20"), d, k, p) for u, d, k, p in rows]
    for bad in (archive[:-3], archive[5:], archive.replace(b" 99\n", b" 98\n"), archive.replace(f"\n{version} 0".encode(), b"\n9 0") if version == 1 else archive[: len(archive) // 2]):
        with pytest.raises(ValueError):
            list(warc.read_arc(bad))
    head, block = next(warc.read_warc(warc.warc_record(got[0], {}, None)))
    assert warc.payload(head, block) == b"a\nb\n" and head["warc-type"] == "response" and head["warc-date"] == "2001-02-03T04:05:06Z" and head["warc-payload-digest"] == "sha1:" + hashlib.sha1(b"a\nb\n").hexdigest()
    head, block = next(warc.read_warc(warc.warc_record(got[1], {}, None)))
    assert head["warc-type"] == "resource" and head["content-type"] == "image/png" and block == b""
    missing = warc.ArcRecord("http://a", "0.0.0.0", "20010203040506", "text/html", "404", b"gone")
    assert b"HTTP/1.1 404 " in warc.warc_record(missing, {}, None)


def test_groups_by_similarity_come_from_fingerprints(spark, monkeypatch):
    """Pairs whose fingerprints are further apart than the radius are not linked, however many shingles they share."""
    rng = np.random.default_rng(9)
    a = rng.integers(0, 1 << 40, 100, dtype=np.uint64)
    sets, prints = [np.sort(a), np.sort(a[:95]), np.sort(a[5:])], [0, 7, (1 << 64) - 1]
    assert simhash.close([0, 7, 7, 255], 3).tolist() == [[False, True, True, False], [False, False, True, False], [False] * 4, [False] * 4]
    assert len(simhash.similar_links([1, 2, 3], sets, [0] * 3, 0.8, [0] * 3)) == 2
    assert {frozenset(x) for x in simhash.similar_links([1, 2, 3], sets, [0] * 3, 0.8, prints)} == {frozenset((1, 2))}
    bits = lambda n, m, both: max((simhash.majority(x[:n]) ^ simhash.majority(x[n - both : n - both + m])).bit_count() for x in rng.integers(0, 2**64, (2000, n + m), dtype=np.uint64))
    assert max(bits(5, 4, 4), bits(9, 9, 8), bits(90, 90, 80)) <= simhash.RADIUS
