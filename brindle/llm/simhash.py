"""SimHash near-duplicate groups, with BK-trees over distinct fingerprints.

Equal fingerprints are one class. Two fingerprints that differ in at most `radius` bits agree on one of radius + 1 blocks
of their bits, so each goes to one shard a block, named by the block's value; a shard builds a BK-tree (children keyed by
their Hamming distance to the parent) and follows only edges within the radius. Shards above SHARD fingerprints are split
again by blocks of the bits that are still free, so a shard stays small while a hot value loses no link; no shard and no
tree leaves the task that built it. A shard gives a spanning forest of its links, not all pairs.

Defined cases: a null or empty text, or one of white space only, has fingerprint zero and links like any other; rows of
equal doc_id each give a row; a null doc_id is never the least of a group; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, drop_path, pack, small_batches, texts, unpack, written
from .components import components
from .vecdup import spanning

#: Fingerprints in a shard above which it is split once more.
SHARD = 2048


def shingles(text: str, k: int) -> np.ndarray:
    """XXH64 (seed 42) of the text's k-word shingles, A-Z in lower case, repeats included; of the whole sequence if it is shorter."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(size + 1) - size - 1
    n = max(1, len(words) - k + 1)
    return np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), (starts + size)[-n:].tolist(), strict=True)], "<u8")


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, k: int) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""
    small_batches(docs.sparkSession)
    schema = pa.schema([pa.field("doc_id", pa.int64()), pa.field("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(schema, b.column("doc_id"), np.array([majority(shingles(t, k)) for t in texts(b.column("text"))], np.uint64).astype(np.int64))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Integers by Hamming distance."""

    def __init__(self):
        self.items: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, x: int) -> None:
        self.items.append(x)
        self.children.append({})
        at, new = 0, len(self.items) - 1
        while at != new:
            at = self.children[at].setdefault((self.items[at] ^ x).bit_count(), new)

    def within(self, x: int, radius: int) -> list[int]:
        """Places of the items at most radius away."""
        found, todo = [], [0] if self.items else []
        while todo:
            at = todo.pop()
            d = (self.items[at] ^ x).bit_count()
            if d <= radius:
                found.append(at)
            todo += [c for e, c in self.children[at].items() if d - radius <= e <= d + radius]
        return found


def forest(items: list[int], radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the graph that joins items at most radius apart."""
    tree, parent, out = BKTree(), [], []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, x in enumerate(items):
        parent.append(i)
        for j in tree.within(x, radius):
            if (r := root(j)) != root(i):
                parent[root(i)] = r
                out.append((x, items[j]))
        tree.add(x)
    return out


def _block(fp: str, low: int, width: int) -> F.Column:
    return F.shiftrightunsigned(F.col(fp), low).bitwiseAND(F.lit((1 << width) - 1))


def _cuts(low: int, width: int, parts: int) -> list[tuple[int, int]]:
    at = [low + width * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(at[:-1], at[1:], strict=True)]


def links(classes: DataFrame, radius: int, shard: int = SHARD) -> DataFrame:
    """Edges (a, b) between distinct fingerprints fp that connect all those at most radius bits apart, directly or not."""
    blocks = _cuts(0, 64, radius + 1)
    routed = classes.select("fp", F.posexplode(F.array(*(_block("fp", *c) for c in blocks))).alias("block", "value")).select("fp", F.col("block").cast("long").alias("block"), "value")
    many = routed.groupBy("block", "value").agg(F.count("*").alias("n")).where("n > 1")
    routed = routed.join(many, ["block", "value"])
    # of a large shard, the bits outside its block are cut into as many blocks once more
    rest = [[c for j, c in enumerate(blocks) if j != i] for i in range(len(blocks))]
    again = F.lit(None).cast("array<long>")
    for i, outside in enumerate(rest):
        cuts = [c for low, width in outside for c in _cuts(low, width, 2)]
        pieces = [cuts[j :: radius + 1] for j in range(radius + 1)]  # radius + 1 disjoint sets of the free bits
        values = []
        for piece in pieces:
            v, up = F.lit(0).cast("long"), 0
            for low, width in piece:
                v, up = v.bitwiseOR(F.shiftleft(_block("fp", low, width), up)), up + width
            values.append(v)
        again = F.when(F.col("block") == i, F.array(*values)).otherwise(again)
    small = routed.where(F.col("n") <= shard).select("fp", "block", "value", F.lit(-1).alias("part"), F.lit(-1).cast("long").alias("free"))
    large = routed.where(F.col("n") > shard).select("fp", "block", "value", F.posexplode(again).alias("part", "free"))
    key = ["block", "value", "part", "free"]
    dealt = small.unionByName(large).repartition(*key).sortWithinPartitions(*key, "fp")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for b in batches for r in zip(*(b[c].tolist() for c in key), b["fp"].tolist(), strict=True))
        out: list[tuple[int, int]] = []
        for _, group in groupby(rows, key=lambda r: r[:4]):
            out += forest([r[4] & (2**64 - 1) for r in group], radius)
            if len(out) > 10_000:
                yield pd.DataFrame(np.array(out, np.uint64).astype(np.int64), columns=["a", "b"])
                out = []
        yield pd.DataFrame(np.array(out, np.uint64).reshape(-1, 2).astype(np.int64), columns=["a", "b"])

    return dealt.mapInPandas(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the least doc_id that links reach from a row."""
    spark = docs.sparkSession
    rows = written(spark, fingerprints(docs, k), "fingerprints")
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    joined = components(links(classes.select("fp"), radius))
    of_class = classes.join(joined, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = of_class.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = of_class.join(least, "component").select("fp", "component_id")
    return rows.join(of_class, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# -- groups by similarity: texts are dealt by bands of min-hashes, BK-trees of their fingerprints find the pairs, and an exact
# check of the shingle sets follows. Fingerprints here are of distinct shingles: counting repeats puts texts of nearly equal sets far apart

#: Differing bits of fingerprints of texts that are compared whole. Of sets of similarity 0.8 a bit differs with a chance of at
#: most 0.19 (sets of four and five shingles; 0.15 for large ones), so more than 28 of 64 do with one below 0.000002.
RADIUS = 28
#: A band is BAND min-hashes; texts of similarity 0.8 agree on one of BANDS with a chance above 0.9999.
BANDS, BAND = 14, 3
#: Classes, and shingles of all of them, in a tile of a shard; two tiles meet in one task.
TILE, WEIGHT = 512, 4 << 20
_FACTORS = np.random.default_rng(7).integers(1, 2**63, BANDS * BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(text: str, k: int) -> tuple[bytes, int, list[int], int, bytes]:
    """A digest of the shingle set, its fingerprint, the band values, the size of the set and the set (40 bits of each hash, sorted, packed)."""
    hashes = shingles(text, k)
    distinct = np.unique(hashes)
    low = np.full(BANDS * BAND, np.iinfo(np.uint64).max)
    for a in range(0, len(distinct), 4096):
        low = np.minimum(low, (distinct[a : a + 4096, None] * _FACTORS).min(0))
    bands = low.reshape(BANDS, BAND)
    value = bands[:, 0].copy()
    for j in range(1, BAND):
        value = (value ^ (value >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + bands[:, j]
    return xxhash.xxh128_digest(distinct.tobytes()), majority(distinct), value.astype(np.int64).tolist(), len(distinct), pack(distinct >> np.uint64(24), delta=True)


#: Cells of a block of the matrix of sets; shingles of more sets than RARE are counted by its products, all others by pairs of sets.
CELLS, RARE = 1 << 22, 32


def close(prints: list[int], radius: int) -> np.ndarray:
    """Which pairs i < j of fingerprints differ in at most radius bits, by a BK-tree."""
    tree, out = BKTree(), np.zeros((len(prints), len(prints)), bool)
    for j, x in enumerate(prints):
        out[tree.within(x, radius), j] = True
        tree.add(x)
    return out


def similar_links(cids: list[int], sets: list[np.ndarray], tiles: list[int], similarity: float, prints: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect what the graph of classes of at least that similarity connects. With two tiles, only pairs of either; with
    fingerprints, only pairs within RADIUS, and sets are looked at only if there is one."""
    n, size = len(sets), np.array([len(s) for s in sets])
    found = None if prints is None else close(prints, RADIUS)
    if found is not None and not found.any():
        return []
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")  # owners rise within a shingle
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(flat)), bool), flat[1:] != flat[:-1])))
    held = np.diff(first, append=len(flat))  # by how many sets
    of = np.repeat(np.arange(len(first)), held)
    both = np.zeros((n, n))
    rare = held[of] <= RARE
    place, who = of[rare], owner[rare]
    for d in range(1, RARE):
        at = np.flatnonzero(place[d:] == place[:-d])
        if not len(at):
            break
        both += np.bincount(who[at] * n + who[at + d], minlength=n * n).reshape(n, n)
    column, who = of[~rare], owner[~rare]
    column = np.cumsum(np.concatenate(([0], column[1:] != column[:-1]))) if len(column) else column
    step = max(1, CELLS // n)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        here = slice(*np.searchsorted(column, (a, a + step)))
        block = np.zeros((n, step), np.float32)
        block[who[here], column[here] - a] = 1
        both += block @ block.T
    near = np.triu(both >= similarity * (size[:, None] + size - both) - 1e-6, 1)
    if found is not None:
        near &= found
    if len({*tiles}) > 1:
        near &= np.array(tiles)[:, None] != np.array(tiles)
    label = spanning(n, *np.nonzero(near))
    return [(cids[i], cids[label[i]]) for i in np.flatnonzero(label != np.arange(n)).tolist()]


def similar_groups(docs: DataFrame, k: int = 5, similarity: float = 0.8, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint and component_id, the least doc_id that links reach: texts whose k-word shingle sets have at least that Jaccard similarity.

    Texts of equal sets are one class (those without words as well). Classes meet in shards named by a band of min-hashes; of a
    shard's classes a task takes two tiles, of bounded numbers of classes and shingles, finds the pairs of near fingerprints in a
    BK-tree and counts what each of them shares. Sets
    are of 40 bits of each shingle's hash: two unlike shingles of a pair of texts of a thousand words count as one with a chance
    of a millionth. Rows of a null doc_id are in no group.
    """
    spark = docs.sparkSession
    small_batches(spark)
    schema = pa.schema([pa.field("doc_id", pa.int64()), pa.field("key", pa.binary()), pa.field("fp", pa.int64()), pa.field("bands", pa.list_(pa.int64())), pa.field("weight", pa.int64()), pa.field("shingles", pa.binary())])

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, fp, bands, weight, sets = zip(*(sketch(t, k) for t in texts(b.column("text"))), strict=True) if b.num_rows else ((),) * 5
            yield batch(schema, b.column("doc_id"), list(key), np.array(fp, np.uint64).astype(np.int64), list(bands), list(weight), list(sets))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(sketches, "doc_id long, key binary, fp long, bands array<long>, weight long, shingles binary")
    rows = written(spark, rows, "sketches")
    light = rows.where("doc_id is not null").select("doc_id", "key", "fp", "bands", "weight")
    # written: the numbers stay. A class is its key, as rows of one doc_id can be in several
    classes = written(spark, light.groupBy("key").agg(F.min("doc_id").alias("least"), F.min("fp").alias("fp"), F.min("bands").alias("bands"), F.min("weight").alias("weight")).withColumn("cid", F.monotonically_increasing_id()), "classes")
    routed = classes.select("cid", "least", "key", "fp", "weight", F.posexplode("bands").alias("band", "value"))
    many = routed.groupBy("band", "value").agg(F.count("*").alias("n"), F.sum("weight").alias("weights")).where("n > 1")
    shards = routed.join(many, ["band", "value"]).withColumn("tiles", F.ceil(F.greatest(F.col("n") / F.lit(tile), F.least("n", F.col("weights") / F.lit(WEIGHT)))).cast("int"))
    shards = shards.withColumn("tile", F.pmod(F.xxhash64("cid"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    shards = written(spark, shards.select("cid", "least", "key", "fp", "band", "value", "tile", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high")), "shards")
    # only sets of classes that meet another go on; their join, the choice of one row and the join with the shards share one partitioning
    need = shards.select("least", "key").distinct()
    whole = rows.select(F.col("doc_id").alias("least"), "key", "shingles").join(need, ["least", "key"]).dropDuplicates(["least", "key"])
    key = ["band", "value", "low", "high"]
    dealt = shards.join(whole, ["least", "key"]).select(*key, "cid", "shingles", "tile", "fp").repartition(*key).sortWithinPartitions(*key, "cid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = pa.schema([pa.field("a", pa.int64()), pa.field("b", pa.int64())])
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in (*key, "cid", "shingles", "tile", "fp")), strict=True))
        out: list[tuple[int, int]] = []
        for _, group in groupby(rows, key=lambda r: r[:4]):
            members = list(group)
            if len(members) > 1:
                out += similar_links([r[4] for r in members], [unpack(r[5]) for r in members], [r[6] for r in members], similarity, [r[7] & (2**64 - 1) for r in members])
            if len(out) > 10_000:
                yield batch(edges, *map(list, zip(*out, strict=True)))
                out = []
        if out:
            yield batch(edges, *map(list, zip(*out, strict=True)))

    edges = dealt.mapInArrow(run, "a long, b long")
    joined = components(edges)
    of_class = classes.join(joined, F.col("cid") == F.col("node"), "left").select("key", "least", F.coalesce("component", "cid").alias("component"))
    least = written(spark, of_class.groupBy("component").agg(F.min("least").alias("component_id")), "least")  # apart, so that the join can split a large component
    of_class = of_class.join(least, "component").select("key", "component_id")
    out = rows.join(of_class, "key", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    out = written(spark, out, "similar-groups")
    for t in (rows, classes, shards, least):
        drop_path(spark, t._brindle_path)
    return out
