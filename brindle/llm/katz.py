"""Language-model scoring: Katz backoff over bigrams.

Counts are discounted by Good-Turing (Katz's form, counts up to K); what a context leaves goes to unseen words in proportion
to the discounted unigram model, with a backoff weight that makes each context sum to one exactly:

    P(w|h) = d(c(h,w)) c(h,w) / c(h)   if c(h,w) > 0,   else a(h) P(w),   a(h) = (1 - sum of seen P(w|h)) / (1 - sum of their P(w))
    P(w)   = d(c(w)) c(w) / N          if c(w) > 0,     else what is left, for one unknown word

A context whose discounts leave nothing, and likewise the unigram model, is scaled as if it had one more count. A text starts
in the context of the end token.

Corpus-wide counts are neither collected nor broadcast. Texts are cut into chunks of CHUNK bytes; a chunk sends its distinct
words, and later its distinct word pairs with their counts, to buckets (by word; by context, or by context and word where the
context is hot). A bucket keeps its part of the count tables and replies to each chunk, in the order asked. The stages:

    A  chunk:  texts to word numbers, kept as packed arrays          -> DOCS, WORDS
    B  bucket: sums counts of words, numbers them                    -> UNIGRAMS, WORD_REPLY
    C  chunk:  distinct pairs                                        -> PAIRS
    D  bucket: sums counts of pairs, statistics of contexts          -> BIGRAMS, PAIR_REPLY
    E  chunk:  evaluates each token recursively and sums by document -> scores

Each stage but C, whose pairs only pass through a shuffle, is a table in the shared folder, partitioned by kind; rows are (chunk, kind, bucket, data), data packed arrays of
a chunk and bucket. The number of buckets follows the size of the texts, so what a task holds doesn't grow with them. Only
count-of-count sums, the sizes of the buckets and the statistics of hot contexts (a bounded number for each bucket) reach the
driver, and go from there to the executors as a broadcast.

Defined cases: a null or empty text has only the end token; a null doc_id counts as not held out; rows of equal doc_id each
count and give a row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered, pack, sized, small_batches, unpack
from .stages import ROWS, drop_kind, frame, grouped, join, record_batch, rows_of, split, stage

#: Bytes of text in a chunk.
CHUNK = 12 << 20
#: Counts above K are not discounted.
K = 5
DOCS, WORDS, WORD_REPLY, UNIGRAMS, SUMS, PAIRS, PAIR_REPLY, BIGRAMS, HOT = range(9)


def held_out() -> F.Column:
    """Rows that are not learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))


# -- the model


def discounts(n: np.ndarray) -> np.ndarray:
    """d[r] for r = 0..K+1 (the last for all larger counts) from n[r], how many types have count r, r up to K + 1."""
    d = np.ones(K + 2)
    if n[1] > 0:
        common = (K + 1) * n[K + 1] / n[1]
        for r in range(1, K + 1):
            if n[r] > 0 and common < 1:
                x = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
                d[r] = x if 0 < x <= 1 else 1
    return d


class Unigrams:
    """Discounted unigram probabilities by count. n[r]: types of count r up to K + 1; total: all tokens; types: distinct ones."""

    def __init__(self, n: np.ndarray, total: int, types: int):
        self.total, self.types, self.d = total, types, discounts(n)
        left = sum((1 - self.d[r]) * r * n[r] for r in range(1, K + 1))
        self.scale = 1.0 if left > 0 else total / (total + 1)
        self.unknown = left / total if left > 0 else 1 / (total + 1)

    def __call__(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.d[np.minimum(c, K + 1)] * c * (self.scale / max(1, self.total)), self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.total + 0.5 * (self.types + 1)))


def backoff(count: np.ndarray, seen: np.ndarray, mass: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For contexts of these counts: the scale of their seen probabilities and the backoff weights. seen[:, r]: tokens in
    followers of count r (0 unused, K + 1: all larger); mass: the followers' sum of unigram probabilities."""
    left = np.maximum(0, (seen * (1 - d)).sum(1))
    none = left <= 0
    scale = np.where(none, count / (count + 1), 1.0)
    weight = np.where(none, 1 / (count + 1), left / np.maximum(count, 1)) / np.maximum(1 - mass, 1e-300)
    return scale, np.where(count > 0, weight, 1.0)


# -- stages


def _tokenise(docs: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, b in enumerate(gathered((x for x in batches if x.num_rows), CHUNK)):
            rows = [(part << 24 | k, *r) for r in chunk_words(b.column("doc_id"), b.column("held_out"), b.column("text"), buckets)]
            yield record_batch(rows)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, ROWS)


def chunk_words(doc_ids: pa.Array, held: pa.Array, docs: pa.Array, buckets: int) -> list[tuple[int, int, bytes]]:
    """The chunk's documents as numbers of its words, and its words by bucket with their counts in documents to learn from."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(docs.cast(pa.large_string())))
    sizes = pc.list_value_length(lists).to_numpy()
    coded = lists.flatten().dictionary_encode()
    at, words = coded.indices.to_numpy(), coded.dictionary.cast(pa.large_binary()).to_pylist()
    end = words.index(b"") if b"" in words else len(words)  # what splitting leaves at a text's ends is empty, and so can stand for the end token
    words = words if end < len(words) else [*words, b""]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    real = at != end
    doc, at = doc[real], at[real]
    sizes = np.bincount(doc, minlength=len(sizes))
    at = np.insert(at, np.cumsum(sizes), end)
    doc = np.repeat(np.arange(len(sizes)), sizes + 1)
    bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
    order = pc.sort_indices(pa.table({"bucket": bucket, "word": pa.array(words, pa.large_binary())}), [("bucket", "ascending"), ("word", "ascending")]).to_numpy().astype(np.int64)
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    learn = ~np.asarray(held)
    ids = rank[at]
    counts = np.bincount(ids[learn[doc]], minlength=len(words))
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
    missing = np.array([i is None for i in doc_ids.to_pylist()])
    out = [(DOCS, -1, join(pack(pc.fill_null(doc_ids, 0).to_numpy()), pack(missing.astype(np.int8)), pack(learn.astype(np.int8)), pack(sizes), pack(ids.astype(np.uint32), level=5)))]
    for k in range(buckets):
        if bounds[k] < bounds[k + 1]:
            part = b" ".join(words[i] for i in order[bounds[k] : bounds[k + 1]])
            out.append((WORDS, k, join(zstandard.compress(part, 1), pack(counts[bounds[k] : bounds[k + 1]]))))
    return out


def bucket_words(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums a bucket's word counts; replies with each word's place in the bucket and its count."""
    bucket = int(rows["bucket"].iloc[0])
    chunks, parts = rows["chunk"].tolist(), [split(d) for d in rows["data"]]
    words = [zstandard.decompress(p[0]).split(b" ") for p in parts]
    sizes = [len(w) for w in words]
    coded = pa.array([w for ws in words for w in ws], pa.large_binary()).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy().astype(np.int64)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    at = rank[coded.indices.to_numpy()]
    total = np.zeros(len(order), np.int64)
    np.add.at(total, at, np.concatenate([unpack(p[1]) for p in parts]))
    n = np.bincount(np.minimum(total, K + 2), minlength=K + 3)
    table = zstandard.compress(b" ".join(coded.dictionary.take(pa.array(order)).to_pylist()), 1)
    out = [(-1, UNIGRAMS, bucket, join(table, pack(total))), (-1, SUMS, bucket, np.array([len(order), total.sum(), (total > 0).sum(), *n], np.int64).tobytes())]
    for c, a, b in zip(chunks, np.cumsum([0, *sizes[:-1]]), np.cumsum(sizes), strict=True):
        out.append((c, WORD_REPLY, bucket, join(pack(at[a:b], delta=True), pack(total[at[a:b]]))))
    return frame(out)


class Chunk:
    """A chunk's documents, with the corpus-wide number and count of each of its words."""

    def __init__(self, rows: pd.DataFrame, start: np.ndarray):
        docs = split(rows.loc[rows["kind"] == DOCS, "data"].iloc[0])
        self.doc_ids, missing, self.learn, self.sizes, self.ids = map(unpack, docs)
        self.missing, self.learn, self.ids = missing.astype(bool), self.learn.astype(bool), self.ids.astype(np.int64)
        replies = rows[rows["kind"] == WORD_REPLY].sort_values("bucket")
        got = [(b, *map(unpack, split(d))) for b, d in zip(replies["bucket"], replies["data"], strict=True)]
        self.number = np.concatenate([start[b] + at for b, at, _ in got])
        self.count = np.concatenate([c for _, _, c in got])
        end = int(self.ids[-1])
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes + 1)
        before = np.empty_like(self.ids)
        before[1:] = self.ids[:-1]
        before[np.concatenate(([0], np.cumsum(self.sizes + 1)[:-1]))] = end
        self.pair = before * len(self.number) + self.ids  # sorts as the corpus-wide numbers do

    def buckets_of(self, before: np.ndarray, after: np.ndarray, buckets: int, hot: int) -> np.ndarray:
        """By context; by context and word for contexts of at least hot counts."""
        x = self.number[before].astype(np.uint64)
        x = np.where(self.count[before] >= hot, x ^ (self.number[after].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), x)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32 if buckets > 32767 else np.int16)

    def distinct(self, pairs: np.ndarray, buckets: int, hot: int) -> tuple[np.ndarray, ...]:
        """Of sorted distinct pairs: their order by bucket, context and word in that order, where each bucket begins."""
        before, after = np.divmod(pairs, len(self.number))
        bucket = self.buckets_of(before, after, buckets, hot)
        order = np.argsort(bucket, kind="stable")
        return order, before[order], after[order], np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=buckets))))


def chunk_pairs(rows: pd.DataFrame, start: np.ndarray, buckets: int, hot: int) -> pd.DataFrame:
    c = Chunk(rows, start)
    both = np.sort(c.pair << 1 | c.learn[c.doc])
    first = np.flatnonzero(np.concatenate(([True], both[1:] >> 1 != both[:-1] >> 1)))
    count = np.add.reduceat(both & 1, first)
    pairs = both[first] >> 1
    del both
    order, before, after, bounds = c.distinct(pairs, buckets, hot)
    count = count[order].astype(np.uint32)
    key = c.number[before].astype(np.uint64) << np.uint64(32) | c.number[after].astype(np.uint64)
    words, contexts = _narrow(c.count[after]), _narrow(c.count[before])
    chunk, out = int(rows["chunk"].iloc[0]), []
    for k in range(buckets):
        if (a := bounds[k]) < (b := bounds[k + 1]):
            out.append((chunk, PAIRS, k, join(pack(key[a:b], delta=True), pack(count[a:b]), pack(words[a:b]), pack(contexts[a:b][_firsts(key[a:b])]))))
    return frame(out)


def _narrow(counts: np.ndarray) -> np.ndarray:
    """Corpus-wide counts in 32 bits where they fit, else as they are."""
    return counts.astype(np.uint32) if counts.max(initial=0) < 1 << 32 else counts


def _firsts(key: np.ndarray) -> np.ndarray:
    """Where another context begins."""
    h = key >> np.uint64(32)
    return np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))


def bucket_pairs(rows: pd.DataFrame, unigrams: Unigrams, hot: int) -> pd.DataFrame:
    """Sums a bucket's pair counts; replies with each pair's count and each context's statistics."""
    bucket = int(rows["bucket"].iloc[0])
    chunks, parts = rows["chunk"].tolist(), [list(map(unpack, split(d))) for d in rows["data"]]
    sizes = np.array([len(p[0]) for p in parts])
    keys, counts, words = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.argsort(keys, kind="stable")
    key = keys[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    total = np.add.reduceat(counts[order].astype(np.int64), first)
    at = np.empty(len(keys), np.int64)
    at[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(key)))
    key, word = key[first], words[order][first].astype(np.int64)
    begin = _firsts(key)
    level = np.where(total > 0, np.minimum(total, K + 1), 0)
    seen = np.stack([np.add.reduceat(np.where(level == r, total, 0), begin) for r in range(1, K + 2)], axis=1)
    mass = np.add.reduceat(np.where(total > 0, unigrams(word), 0.0), begin)
    n = np.bincount(np.minimum(total, K + 2), minlength=K + 3)
    context = (key[begin] >> np.uint64(32)).astype(np.int64)
    of_context = np.zeros(len(context), np.int64)
    out = [(-1, BIGRAMS, bucket, join(pack(key[total > 0], delta=True), pack(_narrow(total[total > 0])))), (-1, SUMS, bucket, n.astype(np.int64).tobytes())]
    ends = np.cumsum(sizes)
    for c, p, a, b in zip(chunks, parts, ends - sizes, ends, strict=True):
        own = p[0][_firsts(p[0])] >> np.uint64(32)
        where = np.searchsorted(context, own.astype(np.int64))
        of_context[where] = p[3]
        out.append((c, PAIR_REPLY, bucket, join(pack(_narrow(total[at[a:b]])), *(pack(_narrow(seen[where, r])) for r in range(K + 1)), pack(mass[where]))))
    is_hot = np.flatnonzero(of_context >= hot)
    out.append((-1, HOT, bucket, join(pack(context[is_hot]), *(pack(seen[is_hot, r]) for r in range(K + 1)), pack(mass[is_hot]))))
    return frame(out)


def chunk_scores(rows: pd.DataFrame, start: np.ndarray, buckets: int, hot: int, unigrams: Unigrams, d: np.ndarray, hot_contexts: dict[int, np.ndarray]) -> pd.DataFrame:
    c = Chunk(rows, start)
    pairs, place = np.unique(c.pair, return_inverse=True)
    order, before, after, bounds = c.distinct(pairs, buckets, hot)
    count, seen, mass = np.zeros(len(pairs), np.int64), np.zeros((len(c.number), K + 2)), np.zeros(len(c.number))
    replies = rows[rows["kind"] == PAIR_REPLY]
    for k, data in zip(replies["bucket"], replies["data"], strict=True):
        got = list(map(unpack, split(data)))
        a, b = bounds[k], bounds[k + 1]
        count[a:b] = got[0]
        where = before[a:b][np.flatnonzero(np.concatenate(([True], before[a + 1 : b] != before[a : b - 1])))]
        seen[where, 1:] = np.stack(got[1:-1], axis=1)
        mass[where] = got[-1]
    for i in np.flatnonzero(c.count >= hot):
        if (x := hot_contexts.get(int(c.number[i]))) is not None:
            seen[i, 1:], mass[i] = x[:-1], x[-1]
    scale, weight = backoff(c.count, seen, mass, d)
    lower = unigrams(c.count)
    p = np.where(count > 0, d[np.minimum(count, K + 1)] * count / np.maximum(1, c.count[before]) * scale[before], weight[before] * lower[after])
    logp = np.empty(len(pairs))
    logp[order] = np.log10(p)
    logp = logp[place]
    n = len(c.sizes)
    total = lambda v: np.bincount(c.doc, v, n)
    known = c.count[c.ids] > 0
    return pd.DataFrame({
        "doc_id": pd.arrays.IntegerArray(c.doc_ids.astype(np.int64), c.missing),
        "held_out": ~c.learn, "n_tokens": c.sizes + 1, "n_known": total(known).astype(np.int64), "train_tokens": np.full(n, unigrams.total), "base_score": total(unigrams.base(c.count)[c.ids]), "score": total(logp),
    })


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each document."""
    spark = docs.sparkSession
    small_batches(spark)
    total, buckets = sized(docs)
    chunks = -(-total // CHUNK)

    a = stage(_tokenise(docs, buckets), "katz-words")
    b = stage(grouped(rows_of(a, WORDS), "bucket", buckets).applyInPandas(bucket_words, ROWS), "katz-unigrams")
    drop_kind(a, WORDS)
    sums = {r.bucket: np.frombuffer(r.data, np.int64) for r in rows_of(b, SUMS).collect()}  # a few numbers a bucket
    start = np.concatenate(([0], np.cumsum([sums[k][0] if k in sums else 0 for k in range(buckets)])))
    if start[-1] >= 1 << 32:
        raise ValueError("a corpus of over 2^32 distinct words")
    whole = np.sum([*sums.values(), np.zeros(K + 6, np.int64)], axis=0)
    unigrams = Unigrams(whole[3:], int(whole[1]), int(whole[2]))
    hot = max(1000, unigrams.total // (8 * buckets))  # so there are at most 8 * buckets hot contexts
    start = start[:-1]
    pairs = grouped(rows_of(a, DOCS).unionByName(rows_of(b, WORD_REPLY)), "chunk", chunks).applyInPandas(lambda x: chunk_pairs(x, start, buckets, hot), ROWS)
    pairs = grouped(pairs, "bucket", buckets).applyInPandas(lambda x: bucket_pairs(x, unigrams, hot), ROWS)
    d = stage(pairs, "katz-bigrams")
    n = np.sum([*(np.frombuffer(r.data, np.int64) for r in rows_of(d, SUMS).collect()), np.zeros(K + 3, np.int64)], axis=0)
    of_pairs = discounts(n)
    hot_contexts: dict[int, np.ndarray] = {}
    for r in rows_of(d, HOT).toLocalIterator():
        context, *stats = map(unpack, split(r.data))
        for i, x in zip(context.tolist(), np.stack(stats, axis=1), strict=True):
            hot_contexts[i] = hot_contexts.get(i, 0) + x
    known = spark.sparkContext.broadcast((start, hot_contexts))
    out = rows_of(a, DOCS).unionByName(rows_of(b, WORD_REPLY)).unionByName(rows_of(d, PAIR_REPLY))
    return grouped(out, "chunk", chunks).applyInPandas(lambda x: chunk_scores(x, known.value[0], buckets, hot, unigrams, of_pairs, known.value[1]), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
