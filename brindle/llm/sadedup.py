"""Removal of long repeated byte strings by sorted suffixes.

A byte is removed if a string of `length` bytes covers it that also starts in a document of smaller doc_id. All matches are
judged on the input, within documents, on UTF-8 bytes.

Equal strings must meet in one shard. Each window of `length` bytes has a minimizer, the least hash of its GRAM-byte grams,
which depends on its bytes alone, and goes to the shard of that hash. What is sorted is as small as it can be without losing a
match: windows whose minimizer no other document has are left out, neighbours with one minimizer go together as a piece, and
equal pieces go once, with the least doc_id. A shard sorts the suffixes of its pieces by external induced sorting
(esais.py); suffixes that follow each other with common prefixes of at least `length` are equal windows, and the least doc_id of
each such run decides them. The reply to a piece marks its windows that start in a smaller document; in all other documents than
the piece's first one, every window of it does.

    A  chunk: texts kept as packed bytes, distinct minimizers      -> DOCS, HASHES
    B  shard: which minimizers two documents have                  -> SHARED
    C  chunk: pieces around those                                  -> PLACES, PIECES
    D  shard: suffix arrays with common prefixes                   -> MARKS
    E  chunk: bytes covered by marked windows

Each stage is a table in the shared folder. The number of shards follows the size of the texts. A hot passage is one piece a
chunk, however many documents hold it; a hot minimizer, of more places than an eighth of a shard has on average, would bring
many unlike pieces to one shard, so its windows go one by one to the shards of their own hashes.

Defined cases: a null or empty text has no bytes; texts shorter than `length` lose nothing; rows of equal doc_id are one
document to each other (none is smaller), each with a row; null doc_ids count as larger than all others and equal to each other;
an empty table gives no rows; kept text drops the bytes of characters that were cut in half.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import gathered, pack, sized, small_batches, spent_by, unpack
from .esais import piece_of, scratch, suffixes
from .stages import ROWS, drop_kind, frame, grouped, join, record_batch, rows_of, split, stage, trimmed

#: Bytes of text in a chunk; bytes that are hashed at a time.
CHUNK, STEP = 6 << 20, 1 << 19
GRAM = 20
#: Places of a minimizer below which it is never hot.
HOT = 10_000
#: Bytes that a shard's sort may hold in memory before it uses scratch files.
MEMORY = 256 << 20
DOCS, HASHES, SHARED, PLACES, PIECES, MARKS = range(10, 16)
#: Stands for a null doc_id.
LAST = np.iinfo(np.int64).max


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _grams(raw: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place."""
    words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,)).copy()
    n = len(raw) - GRAM + 1
    h = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    for at in (8, GRAM - 8):
        h += words[at : at + n]
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def minimizers(raw: np.ndarray, length: int) -> np.ndarray:
    """The minimizer of the window from each place."""
    h, wide, have = _grams(raw), length - GRAM + 1, 1
    while 2 * have <= wide:
        h = np.minimum(h[: len(h) - have], h[have:])
        have *= 2
    return np.minimum(h[: len(h) - (wide - have)], h[wide - have :]) if have < wide else h


def runs(raw: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of one minimizer, within documents that end at ends: first place, windows (at most GRAM + 11), hash."""
    most, starts, sizes, values = length - GRAM + 1, [], [], []
    n = len(raw) - length + 1
    for a in range(0, max(0, n), STEP):
        b = min(n, a + STEP)
        value = minimizers(raw[a : b + length - 1], length)
        at = np.arange(a, b)
        here = ends[slice(*(np.searchsorted(ends, (a, b - 1), "right") + (0, 1)))]
        last = np.repeat(here, np.diff(np.clip(here, a, b), prepend=a)) - length  # the last window of each place's document
        inside = at <= last
        new = np.ones(b - a, bool)
        new[1:] = (value[1:] != value[:-1]) | ~inside[:-1]
        first = np.flatnonzero(new)
        size = np.minimum(np.diff(first, append=b - a), np.maximum(0, last[first] - at[first] + 1))
        pieces = -(-size // most)  # a minimizer that comes again and again: cut
        which = np.repeat(np.arange(len(first)), pieces)
        k = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts.append(at[first][which] + k * most)
        sizes.append(np.minimum(most, size[which] - k * most))
        values.append(_mix(value[first][which]))
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(sizes), np.concatenate(values)


def _bounds(sorted_hashes: np.ndarray, buckets: int) -> np.ndarray:
    edges = [(k << 64) // buckets for k in range(1, buckets)]
    return np.concatenate(([0], np.searchsorted(sorted_hashes, np.array(edges, np.uint64)), [len(sorted_hashes)])).astype(np.int64)


def chunk_hashes(ids: np.ndarray, docs: list[bytes], extra: bytes, length: int, buckets: int) -> list[tuple[int, int, bytes]]:
    joined = b"".join(docs)
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    start, _, value = runs(np.frombuffer(joined, np.uint8), np.cumsum(sizes), length)
    doc = ids[np.searchsorted(np.cumsum(sizes), start, "right")]
    order = np.argsort(value)
    value, doc = value[order], doc[order]
    first = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1]))) if len(value) else np.zeros(0, np.int64)
    many = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first) if len(first) else np.zeros(0, bool)
    held = np.diff(first, append=len(value)).astype(np.uint32)
    value, bounds = value[first], _bounds(value[first], buckets)
    out = [(DOCS, -1, join(pack(ids), pack(sizes), zstandard.compress(joined, 3), extra))]
    doc_of = np.minimum.reduceat(doc, first) if len(first) else doc
    for k in range(buckets):
        if (a := bounds[k]) < (b := bounds[k + 1]):
            out.append((HASHES, k, join(pack(value[a:b], delta=True), np.packbits(many[a:b]).tobytes(), pack(doc_of[a:b] - doc_of[a:b].min()), pack(doc_of[a:b].min()[None]), pack(held[a:b]))))
    return out


def bucket_shared(rows: pd.DataFrame, hot: int) -> pd.DataFrame:
    """For each chunk, which of its minimizers occur in more than one document, and which at `hot` places or more."""
    bucket, chunks = int(rows["bucket"].iloc[0]), rows["chunk"].tolist()
    parts = [split(d) for d in rows["data"]]
    values = [unpack(p[0]) for p in parts]
    sizes = [len(v) for v in values]
    many = np.concatenate([np.unpackbits(np.frombuffer(p[1], np.uint8), count=n).astype(bool) for p, n in zip(parts, sizes, strict=True)])
    doc = np.concatenate([unpack(p[2]) + unpack(p[3])[0] for p in parts])
    values = np.concatenate(values)
    order = np.argsort(values, kind="stable")
    v, d = values[order], doc[order]
    first = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
    shared = (np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)) | np.logical_or.reduceat(many[order], first)
    many_places = np.add.reduceat(np.concatenate([unpack(p[4]) for p in parts])[order].astype(np.int64), first) >= hot
    flags = np.empty((2, len(values)), bool)
    flags[:, order] = np.repeat([shared, many_places], np.diff(first, append=len(v)), axis=1)
    ends = np.cumsum(sizes)
    return frame([(c, SHARED, bucket, join(*(np.packbits(f[a:b]).tobytes() for f in flags))) for c, a, b in zip(chunks, ends - sizes, ends, strict=True)])


class Chunk:
    def __init__(self, rows: pd.DataFrame):
        ids, sizes, joined, self.extra = split(rows.loc[rows["kind"] == DOCS, "data"].iloc[0])
        self.ids, self.sizes = unpack(ids), unpack(sizes)
        self.joined = zstandard.decompress(joined)
        self.raw, self.ends = np.frombuffer(self.joined, np.uint8), np.cumsum(self.sizes)


def chunk_pieces(rows: pd.DataFrame, length: int, buckets: int) -> pd.DataFrame:
    c = Chunk(rows)
    start, size, value = runs(c.raw, c.ends, length)
    order = np.argsort(value)
    value = value[order]
    first = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1]))) if len(value) else np.zeros(0, np.int64)
    bounds, shared, hot = _bounds(value[first], buckets), np.zeros(len(first), bool), np.zeros(len(first), bool)
    replies = rows[rows["kind"] == SHARED]
    for k, data in zip(replies["bucket"], replies["data"], strict=True):
        for flags, bits in zip((shared, hot), split(data), strict=True):
            flags[bounds[k] : bounds[k + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(bounds[k + 1] - bounds[k])).astype(bool)
    held = np.diff(first, append=len(value))
    keep, hot = np.repeat(shared, held), np.repeat(shared & hot, held)[np.repeat(shared, held)]
    order, value = order[keep], value[keep]
    start, size = start[order], size[order]
    if hot.any():
        n = size[hot]
        one = np.repeat(start[hot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        own = np.array([xxhash.xxh64_intdigest(c.joined[a : a + length], 1) for a in one.tolist()], np.uint64)
        start, size, value = np.concatenate((start[~hot], one)), np.concatenate((size[~hot], np.ones(len(one), size.dtype))), np.concatenate((value[~hot], own))
        order = np.argsort(value, kind="stable")
        start, size, value = start[order], size[order], value[order]
    doc = c.ids[np.searchsorted(c.ends, start, "right")]
    number: dict[bytes, int] = {}
    joined, tail = c.joined, length - 1
    which = np.array([number.setdefault(joined[a:b], len(number)) for a, b in zip(start.tolist(), (start + size + tail).tolist(), strict=True)], np.int64)
    first_doc = np.full(len(number), LAST)
    np.minimum.at(first_doc, which, doc)
    chunk = int(rows["chunk"].iloc[0])
    out = [(chunk, PLACES, -1, join(pack(start), pack(size.astype(np.uint8)), pack(which), np.packbits(doc == first_doc[which]).tobytes()))]
    pieces = list(number)
    value_of = np.empty(len(pieces), np.uint64)
    value_of[which] = value  # rises with the number, as values were in order
    bounds = _bounds(value_of, buckets)
    for k in range(buckets):
        if (a := bounds[k]) < (b := bounds[k + 1]):
            out.append((chunk, PIECES, k, join(zstandard.compress(b"".join(pieces[a:b]), 1), pack(np.array([len(p) for p in pieces[a:b]], np.uint16)), pack(first_doc[a:b]))))
    return frame(out)


def repeated(pieces: list[bytes], docs: np.ndarray, length: int, memory: int) -> np.ndarray:
    """A bit mask for each piece, of its windows that also start in a piece of smaller doc."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    n, step = int(sizes.sum()) + len(pieces), piece_of(memory)
    ends = np.cumsum(sizes + 1)
    text, at = scratch(n, np.uint16, memory), 0
    for k in range(0, len(pieces), 1 << 12):
        x = np.ones(int((sizes[k : k + (1 << 12)] + 1).sum()), np.uint16)
        x[ends[k : k + (1 << 12)] - 1 - at] = 0
        x[x > 0] += np.frombuffer(b"".join(pieces[k : k + (1 << 12)]), np.uint8)
        text[at : at + len(x)] = x
        at += len(x)
    place, common = suffixes(text, memory)
    mask, a = np.zeros(len(pieces), np.uint64), 0
    while a < n:
        b = min(n, a + step)
        while b < n and common[b] >= length:  # up to where a run of equal windows stops
            more = np.flatnonzero(common[b : b + step] < length)
            b = b + int(more[0]) if len(more) else min(n, b + step)
        first = np.flatnonzero(common[a:b] < length)  # no equal window before; common[a] always is
        size = np.diff(first, append=b - a)
        long = np.flatnonzero(size > 1)
        if len(long):
            begin, size = first[long] + a, size[long]
            where = place[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())].astype(np.int64)
            piece = np.searchsorted(ends, where, "right")
            least = np.minimum.reduceat(docs[piece], np.cumsum(size) - size)
            gone = np.repeat(least, size) < docs[piece]
            np.bitwise_or.at(mask, piece[gone], np.uint64(1) << (where[gone] - (ends - sizes - 1)[piece[gone]]).astype(np.uint64))
        a = b
    return mask


def bucket_marks(rows: pd.DataFrame, length: int, memory: int) -> pd.DataFrame:
    bucket, chunks = int(rows["bucket"].iloc[0]), rows["chunk"].tolist()
    number: dict[bytes, int] = {}
    asked = []
    for data in rows["data"]:
        joined, sizes, doc = split(data)
        joined, ends = zstandard.decompress(joined), np.cumsum(unpack(sizes).astype(np.int64)).tolist()
        asked.append((np.array([number.setdefault(joined[a:b], len(number)) for a, b in zip([0, *ends[:-1]], ends, strict=True)], np.int64), unpack(doc)))
    docs = np.full(len(number), LAST)
    for which, doc in asked:
        np.minimum.at(docs, which, doc)
    mask = repeated(list(number), docs, length, memory)
    return frame([(c, MARKS, bucket, pack(np.where(doc > docs[which], ~np.uint64(0), mask[which]))) for c, (which, doc) in zip(chunks, asked, strict=True)])


def removed_bytes(rows: pd.DataFrame, length: int, buckets: int) -> tuple[Chunk, np.ndarray]:
    """A chunk and which of its bytes go."""
    c = Chunk(rows)
    start, size, which, first = split(rows.loc[rows["kind"] == PLACES, "data"].iloc[0])
    start, size, which = unpack(start), unpack(size).astype(np.int64), unpack(which)
    first = np.unpackbits(np.frombuffer(first, np.uint8), count=len(start)).astype(bool)
    replies = rows[rows["kind"] == MARKS].sort_values("bucket")
    marks = np.concatenate([unpack(d) for d in replies["data"]]) if len(replies) else np.zeros(0, np.uint64)
    mask = np.where(first, marks[which], ~np.uint64(0)) if len(which) else marks
    whole = (np.uint64(1) << size.astype(np.uint64)) - np.uint64(1)
    mask = mask & whole
    full, some = np.flatnonzero(mask == whole), np.flatnonzero((mask != whole) & (mask != 0))
    windows = np.repeat(some, size[some])
    k = np.arange(len(windows)) - np.repeat(np.cumsum(size[some]) - size[some], size[some])
    one = (mask[windows] >> k.astype(np.uint64)) & np.uint64(1) == 1
    begins = np.concatenate((start[full], (start[windows] + k)[one]))
    ends = np.concatenate((start[full] + size[full] - 1, (start[windows] + k)[one])) + length
    edge = np.zeros(len(c.raw) + 1, np.int32)
    np.add.at(edge, begins, 1)
    np.subtract.at(edge, ends, 1)
    np.cumsum(edge, out=edge)
    return c, edge[:-1] > 0


def spans(gone: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Removed bytes and maximal removed runs of each document."""
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    starts = ends - sizes
    inside = starts[(starts > 0) & (starts < len(gone)) & (sizes > 0)]
    begins[inside] = gone[inside]
    total = np.zeros(len(gone) + 1, np.int32)
    out = []
    for marks in (gone, begins):
        np.cumsum(marks, out=total[1:])
        out.append((total[ends] - total[starts]).astype(np.int64))
    return out[0], out[1]


def dedup(docs: DataFrame, length: int = 50, keep: tuple[str, ...] = (), with_text: bool = False, memory: int = MEMORY) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each document; if asked for, text, what is kept (null stays null), and row, a struct of the columns keep."""
    if not GRAM <= length <= GRAM + 62:
        raise ValueError(f"length must be {GRAM} to {GRAM + 62}")
    spark = docs.sparkSession
    small_batches(spark)
    total, buckets = sized(docs)
    hot, chunks = max(HOT, total // (GRAM * 8 * buckets)), -(-total // CHUNK)
    doc, raw = F.col("doc_id").cast("long"), F.col("text").cast("string")
    kept = docs.select(*(F.col(f"`{c}`") for c in keep)).schema if keep else None
    rows = docs.select(doc.alias("doc"), F.coalesce(raw, F.lit("")).alias("text"), raw.isNull().alias("none"), *([F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row")] if keep else []))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, b in enumerate(gathered((x for x in batches if x.num_rows), CHUNK)):
            held, extra = b.drop_columns(["text"]), pa.BufferOutputStream()
            with pa.ipc.new_stream(extra, held.schema) as w:
                w.write_batch(held)
            ids = b.column("doc").fill_null(int(LAST)).to_numpy().copy()
            texts = [t.encode() for t in b.column("text").to_pylist()]
            yield record_batch([(part << 24 | k, *r) for r in chunk_hashes(ids, texts, zstandard.compress(extra.getvalue().to_pybytes(), 1), length, buckets)])

    def finish(table: pa.Table) -> pa.Table:
        c, gone = removed_bytes(table.to_pandas(), length, buckets)
        n, k = spans(gone, c.ends, c.sizes)
        left = [c.raw[a:b][~gone[a:b]].tobytes() if x else c.joined[a:b] for a, b, x in zip((c.ends - c.sizes).tolist(), c.ends.tolist(), n.tolist(), strict=True)]
        held = pa.ipc.open_stream(zstandard.decompress(c.extra)).read_all()
        del gone
        out = {"doc_id": held.column("doc"), "n_bytes": c.sizes, "n_removed": n, "n_spans": k, "kept_sha256": [hashlib.sha256(x).hexdigest() for x in left]}
        if with_text:
            out["text"] = pa.array([None if none else x.decode(errors="ignore") for x, none in zip(left, held.column("none").to_pylist(), strict=True)], pa.string())
        if keep:
            out["row"] = held.column("row")
        trimmed()
        return pa.table(out)

    fields = [StructField("doc_id", LongType()), *(StructField(n, LongType()) for n in ("n_bytes", "n_removed", "n_spans")), StructField("kept_sha256", StringType())]
    fields += [StructField("text", StringType())] * with_text + ([StructField("row", kept)] if keep else [])
    a = stage(rows.mapInArrow(hashes, ROWS), "sadedup-hashes")
    b = stage(grouped(rows_of(a, HASHES), "bucket", buckets).applyInPandas(lambda x: bucket_shared(x, hot), ROWS), "sadedup-shared")
    drop_kind(a, HASHES)
    c = stage(grouped(rows_of(a, DOCS).unionByName(rows_of(b, SHARED)), "chunk", chunks).applyInPandas(lambda x: chunk_pieces(x, length, buckets), ROWS), "sadedup-pieces")
    d = stage(grouped(rows_of(c, PIECES), "bucket", buckets).applyInPandas(lambda x: bucket_marks(x, length, memory), ROWS), "sadedup-marks")
    drop_kind(c, PIECES)
    parts = rows_of(a, DOCS).unionByName(rows_of(c, PLACES)).unionByName(rows_of(d, MARKS))
    return spent_by(grouped(parts, "chunk", chunks).applyInArrow(finish, StructType(fields)), None, a, b, c, d)
