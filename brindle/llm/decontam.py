"""Benchmark decontamination by greedy string tiling.

Tokens are runs of letters, digits and underscores in lower case; a letter of a script written without spaces is a token of
its own. Windows of SEED tokens of the test items are hashed (Karp-Rabin over token numbers) into a sorted table; a running
hash over each document's tokens finds the seeds that it shares with items, which are compared token by token and joined along
diagonals to maximal matches. For each (document, item) pair the longest match is marked, matches that reach into marked
tokens are cut back, and so on until none of SEED tokens is left: tiles never overlap in the item or in the document, and their
order doesn't matter. An item is leaked if tiles cover at least `coverage` of its tokens. Items of LEAST to SEED - 1 tokens are
one seed each, so they are leaked where they stand whole.

Items go to the executors in blocks of at most BLOCK tokens (a longer item is a block of its own), so what is broadcast is
bounded; a larger benchmark is several blocks, which a document passes one after another, with what was found so far.

Defined cases: a null or empty text or item has no tokens; items of fewer than LEAST tokens say too little and never match;
null item_ids are left out; repeated items count once each; of equal coverages the least item_id is named; rows of equal or null
doc_id give a row each, whatever the number of blocks; empty benchmarks leave all documents clean.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_row, batch, of_row, small_batches, texts, written

#: Tokens of the shortest tile, and of the shortest item.
SEED, LEAST = 5, 3
#: Share of an item's tokens that tiles must cover.
COVERAGE = 0.5
#: Tokens of the items that are broadcast at once; blocks that one job takes before its rows are written.
BLOCK, CHAIN = 2_000_000, 4
#: Pairs of a seed in a document and in an item that are compared at once.
PAIRS = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Ranges of letters of scripts that are written without spaces (Thai, Lao, Myanmar, Khmer, kana, Han).
UNSPACED = "฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿"
_words = re.compile(rf"[^\W{UNSPACED}]+|(?![\W_])[{UNSPACED}]").findall


def tokens(text: str) -> list[str]:
    return _words(text.lower())


def _windows(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2^64, of all windows of k numbers."""
    n = len(ids) - k + 1
    out = np.zeros(max(0, n), np.uint64)
    for j in range(k if n > 0 else 0):
        out = out * _BASE + (ids[j : j + n].astype(np.uint64) + np.uint64(1))
    return out


def tile(matches: list[tuple[int, int, int]], k: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: of maximal matches (item place, text place, length), the tiles, longest first; ties by places."""
    heap = [(-n, p, t) for p, t, n in matches]
    heapq.heapify(heap)
    size = max((p + n for p, _, n in matches), default=0)
    in_item, in_text, left, out = bytearray(size), set(), size, []
    while heap and left >= k:
        n, p, t = heapq.heappop(heap)
        if in_item.find(0, p, p - n) < 0:
            continue
        free = [j for j in range(-n) if not in_item[p + j] and t + j not in in_text]
        if len(free) == -n:
            in_item[p : p - n] = b"\1" * -n
            in_text.update(range(t, t - n))
            left += n
            out.append((p, t, -n))
            continue
        start = 0
        for a in range(1, len(free) + 1):
            if a == len(free) or free[a] != free[a - 1] + 1:
                if a - start >= k:
                    heapq.heappush(heap, (start - a, p + free[start], t + free[start]))
                start = a
    return out


class Seeds:
    """The windows of k tokens of some items, by hash."""

    def __init__(self, numbers: dict[int, np.ndarray], k: int):
        self.k = k
        windows = {i: _windows(x, k) for i, x in numbers.items()}
        sizes = [len(h) for h in windows.values()]
        hashes = np.concatenate([*windows.values(), np.zeros(0, np.uint64)])
        item = np.repeat(np.array(list(windows), np.int64), sizes)
        place = np.concatenate([*map(np.arange, sizes), np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.item, self.place = hashes[order], item[order], place[order]


def _runs(item: np.ndarray, place: np.ndarray, text: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
    """Joins matches that follow each other on a diagonal; length counts seeds."""
    order = np.lexsort((text, text - place, item))
    item, place, text, length = item[order], place[order], text[order], length[order]
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (text[1:] - place[1:] != text[:-1] - place[:-1]) | (text[1:] != text[:-1] + length[:-1])
    first = np.flatnonzero(new)
    return item[first], place[first], text[first], np.add.reduceat(length, first) if len(first) else length


class Items:
    """A block of test items, ready to be searched for."""

    def __init__(self, items: list[tuple[int, list[str]]], k: int):
        self.k, self.ids = k, [i for i, _ in items]
        self.vocabulary: dict[str, int] = {}
        numbers = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws], np.int64) for _, ws in items]
        self.size = [len(x) for x in numbers]
        self.start = np.cumsum([0, *self.size])
        self.flat = np.concatenate([*numbers, np.zeros(0, np.int64)])
        by_seed: dict[int, dict[int, np.ndarray]] = {}
        for i, x in enumerate(numbers):
            if len(x):
                by_seed.setdefault(min(k, len(x)), {})[i] = x
        self.seeds = [Seeds(x, n) for n, x in sorted(by_seed.items())]

    def matches(self, ids: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """Maximal matches by item, of at least k tokens or of the whole item."""
        out: dict[int, list[tuple[int, int, int]]] = {}
        for seeds in self.seeds:
            for i, p, t, n in self._of(ids, seeds):
                out.setdefault(i, []).append((p, t, n))
        return out

    def _of(self, ids: np.ndarray, seeds: Seeds) -> Iterator[tuple[int, int, int, int]]:
        k = seeds.k
        if len(ids) < k:
            return
        known = np.concatenate(([0], np.cumsum(ids < 0)))
        at = np.flatnonzero(known[k:] == known[:-k])
        h = _windows(ids, k)[at]
        low, high = np.searchsorted(seeds.hashes, h, "left"), np.searchsorted(seeds.hashes, h, "right")
        at, low, n = at[high > low], low[high > low], (high - low)[high > low]
        found = []
        ends = np.cumsum(n)
        a = 0
        while a < len(at):  # a seed that is frequent in both makes many pairs; each piece leaves its runs only
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
            m = n[a:b]
            text = np.repeat(at[a:b], m)
            seed = np.repeat(low[a:b] - np.cumsum(m) + m, m) + np.arange(m.sum())
            item, place = seeds.item[seed], seeds.place[seed]
            same = np.ones(len(text), bool)
            for j in range(k):
                same &= self.flat[self.start[item] + place + j] == ids[text + j]
            item, place, text = item[same], place[same], text[same]
            found.append(_runs(item, place, text, np.ones(len(item), np.int64)))
            a = b
        if found:
            item, place, text, length = _runs(*map(np.concatenate, zip(*found, strict=True)))
            yield from zip(item.tolist(), place.tolist(), text.tolist(), (length + k - 1).tolist(), strict=True)

    def leaks(self, text: str, coverage: float) -> tuple[int, int | None, float]:
        """How many items are leaked; the most covered one (null without a match) and its coverage."""
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in tokens(text)], np.int64)
        count, best = 0, (0.0, 0, None)
        for i, found in self.matches(ids).items():
            covered = sum(n for _, _, n in tile(found, min(self.k, self.size[i]))) / self.size[i]
            count += covered >= coverage
            best = max(best, (covered, -self.ids[i], self.ids[i]), key=lambda x: x[:2])
        return count, best[2], best[0]


def _blocks(benchmark: DataFrame, k: int, size: int) -> Iterator[Items]:
    """Items in blocks; the driver holds one block at a time."""
    held, n = [], 0
    for r in benchmark.where("item_id is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        if len(words := tokens(r[1] or "")) >= LEAST:
            if held and n + len(words) > size:
                yield Items(held, k)
                held, n = [], 0
            held.append((r[0], words))
            n += len(words)
    if held:
        yield Items(held, k)


def _through(rows: DataFrame, benchmark: DataFrame, k: int, size: int, run) -> DataFrame:
    """rows after run(batches, items) of each block of items in turn."""
    spark, schema = rows.sparkSession, rows.schema
    small_batches(spark)
    for n, items in enumerate(_blocks(benchmark, k, size)):
        if n and n % CHAIN == 0:
            rows = written(spark, rows, "items-passed")
        shared = spark.sparkContext.broadcast(items)
        rows = rows.mapInArrow(lambda batches, shared=shared: run(batches, shared.value), schema)
    return rows


def contamination(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE, block: int = BLOCK) -> DataFrame:
    """doc_id, n_items (leaked items), item_id and coverage of the most covered item, and contaminated."""
    schema = pa.schema([pa.field("doc_id", pa.int64()), pa.field("n_items", pa.int64()), pa.field("item_id", pa.int64()), pa.field("coverage", pa.float64()), pa.field("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for t, n, i, c in zip(texts(b.column("text")), *(b.column(x).to_pylist() for x in ("n_items", "item_id", "coverage")), strict=True):
                more, other, covered = items.leaks(t, coverage)
                if other is not None and (i is None or (covered, -other) > (c, -i)):
                    i, c = other, covered
                got.append((n + more, i, c))
            yield batch(schema, b.column("doc_id"), *([list(c) for c in zip(*got, strict=True)] or [[]] * 3), b.column("text").cast(pa.string()))

    none = (F.lit(0).cast("long").alias("n_items"), F.lit(None).cast("long").alias("item_id"), F.lit(0.0).alias("coverage"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *none, F.col("text").cast("string").alias("text"))
    out = _through(rows, benchmark, seed, block, run)
    return out.select("doc_id", "n_items", "item_id", "coverage", (F.col("n_items") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE, block: int = BLOCK) -> DataFrame:
    """The rows of docs in which no item is leaked, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([items.leaks(t, coverage)[0] == 0 for t in texts(b.column("text"))], pa.bool_()))

    rows = docs.select(as_row(docs), F.col("text").cast("string").alias("text"))
    return _through(rows, benchmark, seed, block, run).select(*of_row(docs.columns))
