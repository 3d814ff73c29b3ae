"""Byte-level BPE encoding and decoding on padded numpy matrices.

Words of like length form one matrix, a word a row, padded with -1. In each round every row merges its leftmost
pair of least rank; pairs are looked up in a hash table with open addressing; the row is then compacted to the
left and rows with nothing to merge leave the matrix. Words wider than WIDE take all equal pairs of least rank in one
round as far as no merge makes a pair of lower rank, which gives the same ids.

Defined cases: a null or empty text has no tokens (sha256 of no bytes); a doc_id may be null or repeated, each row
gives a row; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import small_batches, texts

NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
NO_RANK = np.int64(1 << 40)
WIDE = 512
#: Cells of a matrix, and text parts whose ids are remembered by a worker; what came first stays.
CELLS, WORDS = 1 << 20, 300_000


class PairTable:
    """(left id, right id) -> rank of the merged token, with open addressing and linear probing, all of it vectorised."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << int(np.ceil(np.log2(max(4, 3 * len(keys)))))
        self.mask = np.uint64(size - 1)
        self.keys, self.values = np.full(size, NONE), np.full(size, NO_RANK)
        at, left, self.probes = self._hash(keys), np.arange(len(keys)), 0
        while len(left):
            self.probes += 1
            free = self.keys[at] == NONE
            _, first = np.unique(np.where(free, at, NONE), return_index=True)
            first = first[free[first]]
            self.keys[at[first]], self.values[at[first]] = keys[left[first]], values[left[first]]
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, at = left[rest], (at[rest] + np.uint64(1)) & self.mask

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        x = keys * np.uint64(0x9E3779B97F4A7C15)
        return (x ^ (x >> np.uint64(32))) & self.mask

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks; NO_RANK where a pair doesn't merge or one side is padding (negative)."""
        keys = ((left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) & np.uint64(0xFFFFFFFF))).ravel()
        at, out = self._hash(keys), np.full(keys.shape, NO_RANK)
        open_ = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        at = at[open_]
        while len(open_):
            there = self.keys[at]
            hit = there == keys[open_]
            out[open_[hit]] = self.values[at[hit]]
            on = ~hit & (there != NONE)
            open_, at = open_[on], (at[on] + np.uint64(1)) & self.mask
        return out.reshape(left.shape)


class ByteBpe:
    """ranks: token bytes -> id; the ids are the merge ranks. pattern splits a text into words, each encoded on its own."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.bytes = [b""] * (max(ranks.values()) + 1)
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            self.bytes[rank] = token
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        keys = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        self.pairs = PairTable(keys, np.array(merged, np.int64))
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.known: dict[str, bytes | None] = {}
        self.heads: dict[str, bytes | None] = {}

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBpe:
        """Reads lines of base64 token and rank."""
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    # -- words to ids

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        buckets: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if (whole := self.ranks.get(w)) is not None:
                out[i] = whole.to_bytes(4, "little")
            elif w:
                buckets.setdefault(max(2, 1 << (len(w) - 1).bit_length()), []).append(i)
        for width, rows in buckets.items():
            if width > WIDE:
                for i in rows:
                    out[i] = self._wide(self.single[np.frombuffer(words[i], np.uint8)]).astype("<u4").tobytes()
                continue
            step = max(1, CELLS // width)
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                for i, ids in zip(part, self._matrix([words[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _matrix(self, words: list[bytes], width: int) -> list[bytes]:
        size = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        cols = np.arange(width)
        ids = np.where(cols < size[:, None], self.single[raw], -1)
        ranks = np.concatenate((self.pairs(ids[:, :-1], ids[:, 1:]), np.full((len(words), 1), NO_RANK)), axis=1)
        done, live = np.empty((len(words), width), np.int64), np.arange(len(words))
        while len(live):
            at = ranks.argmin(axis=1)  # the first of equal ranks: the leftmost
            rows = np.arange(len(live))
            best = ranks[rows, at]
            if (over := best == NO_RANK).any():
                done[live[over], : ids.shape[1]], done[live[over], ids.shape[1] :] = ids[over], -1
                on = ~over
                ids, ranks, live, at, best = ids[on], ranks[on], live[on], at[on], best[on]
                if not len(live):
                    break
                rows = np.arange(len(live))
            ids[rows, at] = best
            shift = cols[: ids.shape[1] - 1] + (cols[: ids.shape[1] - 1] > at[:, None])
            ids, ranks = np.take_along_axis(ids, shift, 1), np.take_along_axis(ranks, shift, 1)  # each row is one shorter
            last = ids.shape[1] - 1
            right = np.where(at < last, ids[rows, np.minimum(at + 1, last)], -1)
            ranks[rows, at] = self.pairs(ids[rows, at], right)
            before = at > 0
            ranks[rows[before], at[before] - 1] = self.pairs(ids[rows[before], at[before] - 1], ids[rows[before], at[before]])
        keep = done >= 0
        flat, ends = done[keep].astype("<u4").tobytes(), np.cumsum(keep.sum(1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _wide(self, ids: np.ndarray) -> np.ndarray:
        ranks = self.pairs(ids[:-1], ids[1:])
        while len(ranks) and (best := ranks.min()) != NO_RANK:
            at = np.flatnonzero(ranks == best)
            run = np.flatnonzero(np.diff(at, prepend=-2) != 1)  # overlapping pairs (a a a): every second of a run counts
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(run, append=len(at)))) % 2 == 0]
            merged = np.full(len(at), best)
            before = np.where(at > 0, ids[at - 1], -1)
            if len(at) > 1:
                before[1:] = np.where(at[1:] == at[:-1] + 2, best, before[1:])
            after = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
            lower = np.flatnonzero((self.pairs(before, merged) < best) | (self.pairs(merged, after) < best))
            at = at[: lower[0] + 1] if len(lower) else at
            ids[at] = best
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, ranks = ids[keep], np.append(ranks, NO_RANK)[keep]
            at = at - np.arange(len(at))
            for near in (at, at[at > 0] - 1):
                near = near[near < len(ids) - 1]
                ranks[near] = self.pairs(ids[near], ids[near + 1])
            ranks = ranks[: len(ids) - 1]
        return ids

    # -- texts

    def _learn(self, parts: set[str], known: dict[str, bytes | None], lead: str) -> None:
        """Ids of the text between two single spaces. None marks parts next to further white space, where a word could reach over the border."""
        safe = [p for p in parts if p and not p[0].isspace() and not p[-1].isspace()]
        split = [self.find(lead + p) for p in safe]
        words = list({w for ws in split for w in ws})
        ids = dict(zip(words, self.encode_words([w.encode() for w in words]), strict=True))
        known.update(dict.fromkeys(parts))
        known.update({p: b"".join(map(ids.__getitem__, ws)) for p, ws in zip(safe, split, strict=True)})

    def encode_many(self, docs: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers. New words of all the texts are encoded together."""
        split = [text.split(" ") for text in docs]
        new = set().union(*(parts[1:] for parts in split)) - self.known.keys()
        heads = {parts[0] for parts in split} - self.heads.keys()
        self._learn(new, self.known, " ")
        self._learn(heads, self.heads, "")
        known = self.known.__getitem__
        out: list[bytes | None] = []
        for parts in split:
            try:
                out.append(self.heads[parts[0]] + b"".join(map(known, parts[1:])))
            except TypeError:  # further white space
                out.append(None)
        if rest := [i for i, x in enumerate(out) if x is None]:
            found = [self.find(docs[i]) for i in rest]
            words = list({w for ws in found for w in ws})
            ids = dict(zip(words, self.encode_words([w.encode() for w in words]), strict=True))
            for i, ws in zip(rest, found, strict=True):
                out[i] = b"".join(map(ids.__getitem__, ws))
        for memory, more in ((self.known, new), (self.heads, heads)):
            if len(memory) > WORDS:
                for p in more:
                    del memory[p]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[tuple[str, str], ByteBpe] = {}


def codec(path: str, pattern: str) -> ByteBpe:
    """One for each worker process."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = ByteBpe.from_file(path, pattern)
    return _codecs[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, digests: bool = False, ids: bool | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens and, unless digests are asked for instead, ids as an array; with digests, ids_sha256 and decoded_sha256 of the
    ids and of the bytes they decode to (ids=True gives both); with keep, row, a struct of those columns."""
    small_batches(docs.sparkSession)
    ids = not digests if ids is None else ids
    fields = [StructField("doc_id", LongType()), StructField("n_tokens", LongType())]
    fields += [StructField("ids", ArrayType(IntegerType()))] * ids + [StructField(n, StringType()) for n in ("ids_sha256", "decoded_sha256")] * digests
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *([F.struct(*(docs[f"`{c}`"] for c in keep)).alias("row")] if keep else []))
    fields += [rows.schema["row"]] if keep else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for b in batches:
            found = bpe.encode_many(texts(b.column("text")))
            sizes = [len(x) // 4 for x in found]
            out = [b.column("doc_id"), pa.array(sizes, pa.int64())]
            if ids:
                offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
                out.append(pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(found), "<i4"))))
            if digests:
                out += [pa.array([hashlib.sha256(x).hexdigest() for x in found], pa.string()), pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*out, *([b.column("row")] if keep else [])], names=[f.name for f in fields])

    return rows.mapInArrow(run, StructType(fields))
