"""Tokenizer operators against the libraries and brute force."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from brindle.llm import bpe, idstore, maxmatch
from brindle.llm.queries import BYTE_BPE, END_ID, PATTERN, PIECES, QUERIES, WORD_BPE

ODD = ["", " ", "  ", "\n\n a", "a  b", " a ", "x\t y", "it's 12 o'clock!", "ñandú É日本", "a" * 700, "ab" * 400, "%%%$$$", "\x1c!\xa0!", "<|endoftext|> x", "é é Σας İ"]


def documents(spark, sf):
    """Real documents, then odd ones, nulls and repeats, with columns whose names clash."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60)
    extra = [(10_000 + i, t) for i, t in enumerate(ODD)] + [(20_000, None), (None, "no id"), (10_003, "again"), (10_003, "again")]
    from pyspark.sql import functions as F

    return docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string")).select("*", F.lit("x").alias("ids"), F.lit(1).alias("n_tokens"), F.lit(2).alias("part"), F.lit(0).alias("key"))


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE_BPE, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_the_librarys(encoding):
    codec = bpe.codec(BYTE_BPE, PATTERN)
    random.seed(3)
    parts = ["a", "b", " ", "  ", "\n", "\t", "é", "日", "1", "23", "!", "aa", "the", "'s", "\x1c", "%%%"]
    docs = ODD + ["".join(random.choices(parts, k=random.randint(0, 60))) for _ in range(500)] + ["".join(random.choices("etaoinshr", k=3000)), "a" * 5001]
    for t, ids in zip(docs, codec.encode_many(docs), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == encoding.encode_ordinary(t)
        assert codec.decode(ids) == t.encode()


def test_bpe_of_a_vocabulary_whose_merges_rank_below_their_parts():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 300, b"bc": 310, b"abc": 290, b"abab": 280, b"cab": 270}
    codec = bpe.ByteBpe(ranks, r"[a-z]+")
    other = tiktoken.Encoding("o", pat_str=r"[a-z]+", mergeable_ranks=ranks, special_tokens={})
    random.seed(4)
    words = ["".join(random.choices("abc", k=random.choice([3, 9, 40, 900]))) for _ in range(150)]
    for w, ids in zip(words, codec.encode_words([w.encode() for w in words]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == other.encode_ordinary(w)


def test_memory_of_words_is_bounded(monkeypatch, encoding):
    monkeypatch.setattr(bpe, "WORDS", 5)
    codec = bpe.ByteBpe.from_file(BYTE_BPE, PATTERN)
    for t in ("a b c d", "e f g h i j", "a e k"):
        assert np.frombuffer(codec.encode_many([t])[0], "<u4").tolist() == encoding.encode_ordinary(t)
    assert len(codec.known) <= 5


def test_op1_rows(spark, sf, encoding):
    docs = documents(spark, sf)
    got = sorted(map(tuple, bpe.encode(docs, BYTE_BPE, PATTERN, digests=True).collect()), key=str)
    want = []
    for r in docs.collect():
        ids = encoding.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert [len(r.ids) == r.n_tokens for r in bpe.encode(docs, BYTE_BPE, PATTERN).collect()] == [True] * len(want)
    assert bpe.encode(docs.limit(0), BYTE_BPE, PATTERN, digests=True).count() == 0


def test_op7_rows(spark, sf):
    docs, library = documents(spark, sf), Tokenizer.from_file(WORD_BPE)
    got = sorted((tuple(r) for r in idstore.checksums(idstore.stored(docs.repartition(5), WORD_BPE, END_ID)).collect()), key=lambda r: r[1])
    start, want = 0, []
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")):
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, END_ID], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    assert idstore.checksums(idstore.stored(docs.limit(0), WORD_BPE, END_ID)).count() == 0


def test_chunks_are_the_librarys(monkeypatch):
    library = Tokenizer.from_file(WORD_BPE)
    monkeypatch.setattr(idstore, "PIECES", 20)
    enc = idstore.ChunkEncoder(WORD_BPE)
    random.seed(5)
    parts = ["a", "Word", " ", "\n", "é", "é", "Σ", "日", "1", "!!", "the", "'s", "\x1c", "\xa0", "<|endoftext|>", "<|startoftext|>", "İ", "don't", "ﬁ"]
    docs = ODD + ["".join(random.choices(parts, k=random.randint(0, 30))) for _ in range(400)] + [None]
    ids, sizes = enc.encode(pa.array(docs, pa.string()))
    ends = np.cumsum(sizes)
    assert [ids[b - n : b].tolist() for b, n in zip(ends, sizes, strict=True)] == [library.encode(t or "", add_special_tokens=False).ids for t in docs]


def brute(word, initial, inner):
    n = i = 0
    while i < len(word):
        j = next((j for j in range(len(word), i, -1) if word[i:j] in (inner if i else initial)), None)
        if j is None:
            return 1
        i, n = j, n + 1
    return n


def test_longest_match_against_brute_force():
    random.seed(6)
    for _ in range(600):
        initial, inner = ({"".join(random.choices("ab", k=random.randint(1, 5))) for _ in range(random.randint(0, 8))} for _ in range(2))
        m = maxmatch.MaxMatch(initial, inner)
        for _ in range(10):
            w = "".join(random.choices("aaabbbc", k=random.randint(1, 14)))
            assert m.pieces(w) == brute(w, initial, inner)


def test_op4_rows(spark, sf):
    docs = documents(spark, sf)
    got = sorted(map(tuple, maxmatch.token_counts(docs, PIECES).collect()), key=str)
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=PIECES)
    pieces = {sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    initial, inner = {p for p in pieces if p.startswith("▁")}, {p for p in pieces if not p.startswith("▁")}
    want = [(r.doc_id, sum(brute("▁" + w.decode(), initial, inner) for w in (r.text or "").encode().split())) for r in docs.collect()]
    assert got == sorted(want, key=str)


def test_queries_run_over_whole_tables(spark, sf):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name in ("op1_byte_bpe", "op4_token_counts", "op7_token_store"):
        assert QUERIES[name](spark, sf).count() == n


def test_token_files_can_be_read_selectively(spark, tmp_path):
    """Encodings, page indexes and row groups of the files, and reads of some documents or of metadata only."""
    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    words = [f"w{i}" for i in range(3000)]
    random.seed(7)
    rows = [(i, " ".join(random.choices(words[:40] if i < 1500 else words, k=60))) for i in range(3000)]
    idstore.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), WORD_BPE, END_ID, path := str(tmp_path / "ids"))
    files = sorted((tmp_path / "ids").glob("part-*.parquet"))
    seen = set()
    for f in files:
        p = pq.ParquetFile(f)
        if not p.metadata.num_rows:
            continue
        names = p.schema.names
        for g in range(p.metadata.num_row_groups):
            group = p.metadata.row_group(g)
            for c in range(group.num_columns):
                column = group.column(c)
                assert column.has_offset_index and column.has_column_index
                seen |= {(names[c], e) for e in column.encodings}
        ids = p.read(columns=["doc_id"]).column(0).to_pylist()
        assert ids == sorted(ids)
    assert ("doc_id", "DELTA_BINARY_PACKED") in seen or ("doc_id", "RLE_DICTIONARY") in seen
    assert any(e in ("RLE_DICTIONARY", "DELTA_BINARY_PACKED") for n, e in seen if n == "element")
    store = idstore.read(spark, path)
    some = store.where(F.col("doc_id").between(100, 104)).select("doc_id", "start", "ids")
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,100)" in some._jdf.queryExecution().toString()
    library = Tokenizer.from_file(WORD_BPE)
    assert {r.doc_id: list(r.ids) for r in some.collect()} == {i: [*library.encode(t, add_special_tokens=False).ids, END_ID] for i, t in rows[100:105]}
    light = store.select("doc_id", "start", "n_tokens")
    assert "ids:" not in light._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1].split("\n")[0]
    assert light.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0] == sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows)


def test_texts_far_longer_than_any_in_the_tables(spark):
    """Texts of two million bytes, of one word and of many, through the operators of single texts."""
    from brindle.llm import katz, simhash

    random.seed(8)
    many = " ".join(random.choices([f"word{i}" for i in range(5000)], k=220_000))
    docs = spark.createDataFrame([(1, many), (2, "ab" * 200_000), (3, "same " * 200_000), (4, "short one")], "doc_id long, text string")
    texts = {r.doc_id: r.text for r in docs.collect()}
    library = Tokenizer.from_file(WORD_BPE)
    got = {r.doc_id: r.ids for r in idstore.stored(docs, WORD_BPE, END_ID).collect()}
    for i in (1, 3, 4):
        assert list(got[i]) == [*library.encode(texts[i], add_special_tokens=False).ids, END_ID]
    counts = {r.doc_id: r.n_tokens for r in maxmatch.token_counts(docs, PIECES).collect()}
    assert counts[3] % 200_000 == 0 and counts[3] >= 200_000
    prints = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, 3, 2).collect()}
    assert len({f for f, _ in prints.values()}) == 4 and all(c == i for i, (_, c) in prints.items())
    scored = {r.doc_id: r for r in katz.scores(docs).collect()}
    assert {i: r.n_tokens for i, r in scored.items()} == {1: 220_001, 2: 2, 3: 200_001, 4: 3} and all(r.score < 0 for r in scored.values())
