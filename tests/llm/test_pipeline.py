"""The pipeline's stages, each on what its predecessor kept, against plain Python."""

import base64
import collections
import hashlib
import re

import numpy as np
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from brindle.llm import decontam, quality
from brindle.llm.common import table
from brindle.llm.queries import BYTE_BPE, PATTERN


def shingles(text):
    w = (text or "").encode().lower().split()
    return {xxhash.xxh64_intdigest(b" ".join(w[j : j + 5])) for j in range(max(1, len(w) - 4))} if w else set()


def similar(rows):
    """The least doc_id of each group of similar texts."""
    parent = {i: i for i in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {i: shingles(t) for i, t in rows.items()}
    for i in rows:
        for j in rows:
            if i < j:
                both = len(sets[i] & sets[j])
                if sets[i] == sets[j] or both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
    return {i for i in rows if find(i) == i}


def without_repeats(rows):
    first, out = {}, {}
    for i in sorted(rows):
        b = (rows[i] or "").encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    for i, t in rows.items():
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        out[i] = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode(errors="ignore") if any(gone) else t
    return out


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "repeated_passages", "decontamination", "token_ids"]
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    all_docs = texts(docs)
    step = stages["quality"](spark, docs, sf).cache()
    good = {r.doc_id for r in quality.classify(docs, table(spark, sf, "labels")).where("predicted = 1").collect()}
    assert step.columns == docs.columns and texts(step) == {i: all_docs[i] for i in good}
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    assert sum(labels[i] for i in good if i in labels) > 0.9 * sum(labels.values())
    step = stages["near_duplicates"](spark, step, sf).cache()
    kept = similar({i: all_docs[i] for i in good})
    assert texts(step) == {i: all_docs[i] for i in kept} and len(kept) < len(good)
    step = stages["repeated_passages"](spark, step, sf).cache()
    want = without_repeats({i: all_docs[i] for i in kept})
    assert texts(step) == want and want != {i: all_docs[i] for i in kept}
    assert all(r.n_chars == len(r.text) for r in step.collect() if r.text != all_docs[r.doc_id])
    step = stages["decontamination"](spark, step, sf).cache()
    items = [decontam.tokens(r.text) for r in table(spark, sf, "benchmark").collect()]
    clean = {i: t for i, t in want.items() if not any(leaks(x, decontam.tokens(t or "")) for x in items)}
    assert texts(step) == clean and len(clean) < len(want)
    want = clean
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE_BPE, "rb"))}
    encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    last = stages["token_ids"](spark, step.withColumn("n_tokens", F.lit("own")), sf)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids, r.source, r.n_tokens_) for r in last.collect()}
    ids = {i: np.array(encode(t or ""), "<u4") for i, t in want.items()}
    sources = {r.doc_id: r.source for r in docs.collect()}
    assert got == {i: (len(x), hashlib.sha256(x.tobytes()).hexdigest(), hashlib.sha256((want[i] or "").encode()).hexdigest(), x.tolist(), sources[i], "own") for i, x in ids.items()}
    whole = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id: r.ids for r in whole} == {i: x.tolist() for i, x in ids.items()} and "lang" in whole[0].asDict()


def leaks(item, text, k=5, share=0.5):
    """Whether greedy tiles of the item in the text cover half of it, by the definition: the longest match of free tokens first."""
    k = min(k, len(item))
    if len(item) < 3 or not {tuple(item[i : i + k]) for i in range(len(item) - k + 1)} & {tuple(text[i : i + k]) for i in range(len(text) - k + 1)}:
        return False
    in_item, in_text, covered = set(), set(), 0
    places = collections.defaultdict(list)
    for j, w in enumerate(text):
        places[w].append(j)
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in places[item[i]]:
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and i + n not in in_item and j + n not in in_text:
                    n += 1
                best = max(best, (n, -i, -j))
        if best[0] < k:
            return covered >= share * len(item)
        n, i, j = best[0], -best[1], -best[2]
        in_item |= {*range(i, i + n)}
        in_text |= {*range(j, j + n)}
        covered += n


def test_odd_rows_and_clashing_columns(spark, sf):
    odd = [(900_001, None, "en", "s", None), (900_002, "", None, None, 0), (900_003, " \n", "en", "s", 2), (None, "a text without an id", "en", "s", 20), (900_004, "same " * 40, "en", "s", 200), (900_004, "same " * 40, "en", "s", 200), (900_005, "word " * 200_000, "en", "s", 1_000_000)]
    docs = table(spark, sf, "documents").limit(20)
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    for name in ("score", "_score", "fp", "key", "row", "doc", "none", "cid", "n_bytes", "_words", "held_out", "gone"):
        docs = docs.withColumn(name, F.lit(name))
    docs = docs.withColumn("a.b", F.lit(1))
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, step, sf)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert all(r["score"] == "score" and r["gone"] == "gone" for r in rows)
        assert stage(spark, step.limit(0), sf).count() == 0, name
        step = stage(spark, docs, sf) if name == "quality" else out
        if name == "quality":
            step = docs  # the next stages see every odd row
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()


def test_nothing_else_imports_it():
    import pathlib

    top = pathlib.Path(corpus_pipeline.__file__).parent
    for p in (top / "brindle").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"\bllm\b.*import|import.*\bllm\b", p.read_text()), p
