"""Vector code compression: product codebooks over whole numbers, assigned by screened float32 matrix products.

Each component x counts as floor(256 x); a vector is cut into 16 equal parts, and each part position has a codebook of 64
entries. The nearest entry of a part is that of least |e|^2 - 2 p.e. A float32 product gives all p.e of a block of parts at
once, with |error| <= g |p| |e|, g = s u / (1 - s u) for s components and u = 2^-24, whatever the order of summation. Entries
whose interval overlaps the least upper bound are computed again in int64; of equal distances the lower index wins.

A codebook is replaced from sums that each task makes of its own rows: a row for each entry and component goes to the shuffle,
not the parts. Codebooks (64 vectors for each length of vectors) are all that passes through the driver.

Defined cases: rows whose vector is null or holds null or non-finite components go. Vectors of each length are coded by
themselves, with codebooks of their own; a length that 16 does not divide is filled up with zeros, and an empty vector has the
code of zeros and no error. Fewer than 64 vectors make as many entries. Rows that share a vec_id are entries in the order of
their vectors; null vec_ids come last. Components beyond +-2^22 (x beyond +-16,384) count as that bound, so all sums are
exact; a sum over a label that 64 bits can't hold is null. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import spent_by, written

PARTS, ENTRIES, ROUNDS, SCALE, BOUND = 16, 64, 2, 256, 1 << 22
#: Parts whose products with a codebook are held at once.
BLOCK = 4096


def whole(x: np.ndarray) -> np.ndarray:
    """Rows of components as whole numbers, (rows, PARTS, s)."""
    with np.errstate(over="ignore"):
        v = np.clip(np.floor(x * SCALE), -BOUND, BOUND).astype(np.int64)
    return np.pad(v, ((0, 0), (0, -v.shape[1] % PARTS))).reshape(len(v), PARTS, -(-v.shape[1] // PARTS))


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of parts (n, s) the index of the nearest of entries (m, s), the lowest of equal ones, and its squared distance."""
    index, error = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    s, b = parts.shape[1], entries.astype(np.float32)  # exact: below 2^24
    square = (entries * entries).sum(1)
    length = np.sqrt(square.astype(np.float64)) * (1 + 2.0**-50)
    unit = s * 2.0**-24
    for k in range(0, len(parts), BLOCK):
        p = parts[k : k + BLOCK]
        own = np.sqrt((p * p).sum(1).astype(np.float64)) * (1 + 2.0**-50)
        reach = own[:, None] * length
        middle = square - 2.0 * (p.astype(np.float32) @ b.T)
        gap = 2 * unit / (1 - unit) * reach + 2.0**-50 * (square + 2 * reach)  # and what double precision rounds here
        i, j = np.nonzero(middle - gap <= (middle + gap).min(1)[:, None])
        exact = ((p[i] - entries[j]) ** 2).sum(1)
        best = np.minimum.reduceat(exact, np.flatnonzero(np.diff(i, prepend=-1)))  # each part has an open entry
        i, j = i[hit := exact == best[i]], j[hit]
        index[k : k + BLOCK], error[k : k + BLOCK] = j[np.diff(i, prepend=-1) > 0], best
    return index, error


def digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, their parts) for each length of vectors in a batch."""
    size, start, flat = np.diff(column.offsets.to_numpy()), column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    for d in np.unique(size).tolist():
        at = np.flatnonzero(size == d)
        yield d, at, whole(flat[start[at][:, None] + np.arange(d)])


def first_entries(vectors: DataFrame, entries: int) -> dict[int, np.ndarray]:
    """For each length of vectors(vec_id, embedding) the parts of the first rows by vec_id, as (PARTS, entries, s)."""
    out = {}
    for (size,) in vectors.select(F.size("embedding")).distinct().collect():
        rows = vectors.where(F.size("embedding") == size)
        # ids alone find the bound, below which few vectors are sorted
        last = rows.select("vec_id").orderBy(F.asc_nulls_last("vec_id")).limit(entries).agg(F.max("vec_id"), F.count("vec_id")).first()
        if last[1] == entries:
            rows = rows.where(F.col("vec_id") <= last[0])
        got = rows.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).select("embedding").collect()
        out[size] = whole(np.array([r[0] for r in got], np.float64).reshape(len(got), size)).transpose(1, 0, 2)
    return out


def _moved(vectors: DataFrame, books: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """The codebooks after a round: each used entry is the floor of the mean of its parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for b in batches:
            for d, _, v in _by_length(b.column(0)):
                _, entries, s = books[d].shape
                total = sums.setdefault(d, np.zeros((PARTS, entries, s + 1), np.int64))
                for k in range(PARTS):
                    index, _ = nearest(v[:, k], books[d][k])
                    order = np.argsort(index, kind="stable")
                    used, first, n = np.unique(index[order], return_index=True, return_counts=True)
                    total[k, used, 0] += n
                    if s:
                        total[k, used, 1:] += np.add.reduceat(v[order, k], first, axis=0)
        for d, total in sums.items():
            part, entry = np.nonzero(total[:, :, 0])
            rows, place = total[part, entry], np.arange(total.shape[2])
            at = (part * total.shape[1] + entry).repeat(len(place))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), d)), pa.array(at), pa.array(np.tile(place, len(part))), pa.array(rows.ravel())], names=["size", "at", "place", "total"])

    found = vectors.select("embedding").mapInArrow(run, "size long, at long, place long, total long").groupBy("size", "at", "place").agg(F.sum("total").alias("total"))
    out, totals = {}, {d: np.zeros((PARTS, b.shape[1], b.shape[2] + 1), np.int64) for d, b in books.items()}
    for size, at, place, total in found.collect():
        totals[size].reshape(-1, totals[size].shape[2])[at, place] = total
    for d, b in books.items():
        n = totals[d][:, :, :1]
        out[d] = np.where(n > 0, totals[d][:, :, 1:] // np.maximum(n, 1), b)
    return out


def codebooks(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> dict[int, np.ndarray]:
    """For each length of vectors(vec_id, embedding), which must be sound, the final entries (PARTS, entries, s)."""
    books = first_entries(vectors, entries)
    for _ in range(rounds):
        books = _moved(vectors, books)
    return books


def sound(vectors: DataFrame) -> DataFrame:
    """vec_id, label and embedding (doubles) of rows whose vector is whole and finite."""
    e = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where(e.isNotNull() & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def coded(rows: DataFrame, books: dict[int, np.ndarray]) -> DataFrame:
    """rows(vec_id, label, embedding) -> vec_id, label, code, error, codebooks_sha256."""
    digests = {d: digest(b) for d, b in books.items()}
    names = ["vec_id", "label", "code", "error", "codebooks_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, error, sha = np.empty(b.num_rows, object), np.zeros(b.num_rows, np.int64), np.empty(b.num_rows, object)
            for d, at, v in _by_length(b.column(2)):
                index, gone = zip(*(nearest(v[:, k], books[d][k]) for k in range(PARTS)), strict=True)
                raw = np.stack(index, axis=1).astype(np.uint8).tobytes().hex()
                code[at] = [raw[i : i + 2 * PARTS] for i in range(0, len(raw), 2 * PARTS)]
                error[at], sha[at] = sum(gone), digests[d]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(code, pa.string()), pa.array(error), pa.array(sha, pa.string())], names=names)

    kinds = [rows.schema["vec_id"], rows.schema["label"], StructField("code", StringType()), StructField("error", LongType()), StructField("codebooks_sha256", StringType())]
    return rows.mapInArrow(run, StructType(kinds))


def compress(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each sound vector."""
    if not 0 < entries <= 256:
        raise ValueError("an entry's index is two hex digits: 1 to 256 entries")
    rows = sound(vectors)
    table = written(vectors.sparkSession, coded(rows, codebooks(rows, entries, rounds)), "codes")  # read twice
    sums = table.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error"))
    out = table.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return spent_by(out.select("vec_id", "code", "error", "label_error", "codebooks_sha256"), None, table)
