"""Filter interaction audit: what each of five filters removes, in each of the 120 orders in which they can be applied.

Filter E removes texts that a smaller doc_id has as well. A map task gives each of its texts the mask of filters A to D that it
fails and routes it by the xxhash of the text; where texts of one fingerprint meet, a chain holds each different one in full
(packed, the same way everywhere) with its least id, and all other ids fail E.
A task keeps each of its texts once: copies with a larger id fail E there and then, and go on without a text. Texts that a task
has several times meet in groups of tasks before they meet in one, so a text that all tasks have is sent once for each group of
tasks. Masks are then counted in a vector for each task and part, and combineByKey adds the vectors up; all orders are read off
32 counts.

Defined cases: a null text is empty; a null lang belongs to the empty part; a null doc_id is no copy of another and none is of
it; rows that share doc_id and text are no copies of each other; labels that repeat a doc_id count as failing if one of them
does, and labels of rows that share a doc_id count for each of them; no documents give no rows; other columns are not read.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, shuffle_partitions, small_batches, spent_by, written

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
COPY = 1 << FILTERS.index("E")
#: Bytes of packed texts that a map task holds before it passes them on.
HELD = 64 << 20
#: Tasks whose copies of a text meet first.
TASKS = 64
_SYMBOL, _NOT_UPPER = re.compile(rb"[#$%&*|]"), bytes(sorted(set(range(256)) - set(range(65, 91))))
_ROWS = pa.schema([("fingerprint", pa.int64()), ("task", pa.int32()), ("doc_id", pa.int64()), ("part", pa.string()), ("n", pa.int64()), ("mask", pa.int32()), ("body", pa.binary())])


def mask(raw: bytes, points: int) -> int:
    """The filters A to D that a text fails, as bits; points: its code points."""
    words = raw.split()  # of bytes: exactly the six blank characters
    a, b = len(words) < 200, 100 * len(set(words)) < 50 * len(words)
    return a | b << 1 | (100 * len(raw.translate(None, _NOT_UPPER)) > 3 * points) << 2 | (_SYMBOL.search(raw) is not None) << 3


class Chains:
    """Of each fingerprint the different texts, each with its least id and how many rows of each part have that id."""

    def __init__(self) -> None:
        self.chains: dict[int, list[list]] = {}
        self.bytes = 0

    def add(self, fingerprint: int, doc_id: int, part: str, n: int, mask: int, body: bytes) -> tuple:
        """Rows (doc_id, part, n, mask) that fail E for what is known now."""
        chain = self.chains.setdefault(fingerprint, [])
        entry = next((e for e in chain if e[0] == body), None)
        if entry is None:
            chain.append([body, doc_id, {part: n}, mask, False])
            self.bytes += len(body) + 200
            return ()
        entry[4] = True
        if doc_id > entry[1]:
            return ((doc_id, part, n, mask | COPY),)
        if doc_id == entry[1]:
            entry[2][part] = entry[2].get(part, 0) + n
            return ()
        lost = tuple((entry[1], p, k, mask | COPY) for p, k in entry[2].items())
        entry[1], entry[2] = doc_id, {part: n}
        return lost

    def least(self) -> Iterator[tuple]:
        """(fingerprint, doc_id, part, n, mask, body, whether it was met again) of the rows of least id."""
        for fingerprint, chain in self.chains.items():
            for body, doc_id, parts, m, again in chain:
                for part, n in parts.items():
                    yield fingerprint, doc_id, part, n, m, body, again


def masked(docs: DataFrame) -> DataFrame:
    """Rows of a map task: (fingerprint, body) for a text's least id, else without a body. task: null where the task had the text once."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chains, task, pack = Chains(), TaskContext.get().partitionId() // TASKS, zstandard.ZstdCompressor(level=1, write_checksum=False).compress

        def kept() -> pa.RecordBatch:
            return batch(_ROWS, *map(list, zip(*((f, task if again else None, i, p, n, m, body) for f, i, p, n, m, body, again in chains.least()), strict=True)))

        for b in batches:
            done = []
            points = pc.utf8_length(b.column("text")).to_pylist()
            for doc_id, part, raw, length in zip(b.column("doc_id").to_pylist(), b.column("part").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), points, strict=True):
                m = mask(raw, length)
                if doc_id is None:
                    done.append((None, part, 1, m))
                else:
                    done += chains.add(xxhash.xxh64_intdigest(raw) - (1 << 63), doc_id, part, 1, m, pack(raw))
            if done:
                i, p, n, m = map(list, zip(*done, strict=True))
                none = [None] * len(i)
                yield batch(_ROWS, none, none, i, p, n, m, none)
            if chains.bytes > HELD:
                yield kept()
                chains = Chains()
        if chains.chains:
            yield kept()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "fingerprint long, task int, doc_id long, part string, n long, mask int, body binary")


def _met(rows: Iterable[tuple]) -> Iterator[tuple]:
    """((fingerprint, ...), row) pairs of a partition -> the same rows, without a body where they fail E."""
    chains = Chains()
    for (fingerprint, _), (doc_id, part, n, m, body) in rows:
        if body is None:
            yield (None, None), (doc_id, part, n, m, None)
        else:
            for lost in chains.add(fingerprint, doc_id, part, n, m, bytes(body)):
                yield (None, None), (*lost, None)
    for fingerprint, doc_id, part, n, m, body, _ in chains.least():
        yield (fingerprint, None), (doc_id, part, n, m, body)


def _dealt(rows, partitions: int):
    """By the fingerprint and group of tasks; rows without a text in turn, as nothing has to meet."""

    def keyed(task: int, pairs: Iterable[tuple]) -> Iterator[tuple]:
        turn = itertools.count(task)
        for key, row in pairs:
            yield ((None, next(turn) % partitions) if row[-1] is None else key), row

    place = lambda k: k[1] if k[0] is None else (k[0] if k[1] is None else xxhash.xxh64_intdigest(f"{k[0]} {k[1]}".encode())) % partitions
    return rows.mapPartitionsWithIndex(keyed).partitionBy(partitions, place)


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, n, mask) for all rows of docs(doc_id, lang, text): n rows of that id and part fail the filters of the mask."""
    spark = docs.sparkSession
    rows, partitions = written(spark, masked(docs), "masked"), shuffle_partitions(spark)  # read in two parts
    pairs = lambda df: df.rdd.map(lambda r: ((r[0], r[1]), tuple(r[2:])))
    first = _dealt(pairs(rows.where("task is not null")), partitions).mapPartitions(_met)
    both = first.union(pairs(rows.where("task is null")))
    last = _dealt(both, partitions).mapPartitions(_met).map(lambda kv: kv[1][:4])
    return spent_by(spark.createDataFrame(last, "doc_id long, part string, n long, mask int", verifySchema=False), None, rows)


def counts(found: DataFrame, labels: DataFrame):
    """An RDD of (part, counts): for each mask the rows, those labelled good and those labelled toxic, as an array (3, 32)."""
    of = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    joined = found.join(of, "doc_id", "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            part, (m, n, good, toxic) = b.column("part").dictionary_encode(), (b.column(c).to_numpy() for c in ("mask", "n", "good", "toxic"))
            at = part.indices.to_numpy().astype(np.int64) * 3
            total = np.zeros((len(part.dictionary) * 3, 32), np.int64)
            for k, w in enumerate((n, n * good, n * toxic)):
                np.add.at(total, (at + k, m), w)
            for k, p in enumerate(part.dictionary.to_pylist()):
                sums[p] = sums.get(p, 0) + total[3 * k : 3 * k + 3]
        if sums:
            yield batch(pa.schema([("part", pa.string()), ("counts", pa.binary())]), list(sums), [v.tobytes() for v in sums.values()])

    vectors = joined.mapInArrow(run, "part string, counts binary").rdd.map(lambda r: (r[0], np.frombuffer(bytes(r[1]), np.int64).reshape(3, 32)))
    return vectors.combineByKey(lambda v: v.copy(), np.add, np.add)


def orders(total: np.ndarray) -> Iterator[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) from the counts of a part."""
    masks, n = np.arange(32), total[0]
    rows, shapley = [], dict.fromkeys(FILTERS, 0)
    for order in ORDERS:
        before = 0
        for step, f in enumerate(order, 1):
            bit = 1 << FILTERS.index(f)
            fails, stands = masks & bit > 0, masks & before == 0
            removed, good, toxic = (int(x[fails & stands].sum()) for x in total)
            shapley[f] += removed
            before |= bit
            rows.append((order, step, int(n[masks & before == 0].sum()), removed, int(n[fails & ~stands].sum()), int(n[bit]), good, toxic))
    for row in rows:
        yield *row, shapley[row[0][row[1] - 1]]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order and step."""
    found = failures(docs)
    rows = counts(found, labels).flatMap(lambda kv: ((kv[0], *row) for row in orders(kv[1])))
    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return spent_by(docs.sparkSession.createDataFrame(rows, schema, verifySchema=False), found)
