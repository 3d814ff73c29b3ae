"""Embedding near-duplicates: int8 tile products with rigorous error bounds, then full precision where they can't decide.

Equal vectors of a label are one class with a multiplicity. Each class is quantised once: of the unit vector u, q = round(u / s)
as int8, s = max|u| / 127, with the measured error e = |u - s q|. For two vectors |u.v - s t (q.r)| <= e_u |v'| + e_v |u'| +
e_u e_v, with |u'| = |s q|: a pair whose bounds lie on one side of the threshold is decided, as a link or as none. The classes of
a label are dealt into tiles, and each pair of tiles of a label is a task of its own, so a hot label is as many tasks as its size
asks for; what goes to them is int8. Vectors of pairs that the bounds leave open are then fetched in double precision, and those
pairs only are computed again from the stored components.

Integer products up to 2^24 are exact in the single-precision products that stand for them (numpy has no fast int8 product);
vectors too long for that are split into runs of components. A task gives a link count for each class and a spanning forest of
its links, never its pairs.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and those without a label, link
with nothing; vectors of different lengths never link; rows of equal vec_id are told apart by their order only, count each
other as links like other copies, and each give a row; null vec_ids are never the least of a component; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

from .common import drop_path, small_batches, written
from .components import components

#: Vectors in a tile: a task holds two tiles and a block of their product.
TILE = 1024
#: Components whose int8 products stay below 2^24.
RUN = 1024
#: More than double precision loses in a cosine.
SLACK = 1e-9
_QUANTISED = ("q", "scale", "length", "error")


class Quantised(NamedTuple):
    """int8 values, scales, lengths of the quantised vectors and of their errors (rounded up)."""

    q: np.ndarray
    scale: np.ndarray
    length: np.ndarray
    error: np.ndarray


def quantise(vectors: np.ndarray) -> Quantised:
    """Of vectors of any length but zero."""
    unit = vectors / norms(vectors)[:, None]
    scale = np.abs(unit).max(1, initial=0) / 127
    q = np.rint(unit / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
    back = q * scale[:, None]
    up = 1 + 1e-9
    return Quantised(q, scale, np.linalg.norm(back, axis=1) * up, np.linalg.norm(unit - back, axis=1) * up + 1e-12)


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


def decided(a: Quantised, b: Quantised, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places (i, j) of pairs that may reach the threshold, and whether they surely do, some rows of a at a time."""
    step = max(1, (1 << 21) // max(1, len(b.q)))
    for k in range(0, len(a.q), step):
        rows = slice(k, k + step)
        product = np.zeros((len(a.q[rows]), len(b.q)))
        for c in range(0, a.q.shape[1], RUN):
            product += a.q[rows, c : c + RUN].astype(np.float32) @ b.q[:, c : c + RUN].astype(np.float32).T
        product *= a.scale[rows, None] * b.scale
        error = a.error[rows, None] * b.length + b.error * a.length[rows, None] + a.error[rows, None] * b.error + SLACK
        i, j = np.nonzero(product + error >= threshold)
        yield i + k, j, (product - error)[i, j] >= threshold


def exact(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the cosines of rows i of a and j of b reach the threshold, in double precision."""
    na, nb, out = norms(a), norms(b), []
    for m in range(0, len(i), 1 << 16):
        x, y = i[m : m + (1 << 16)], j[m : m + (1 << 16)]
        out.append((a[x] * b[y]).sum(1) / (na[x] * nb[y]) >= threshold)
    return np.concatenate([*out, np.zeros(0, bool)])


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least node that links (i, j) reach from each of n nodes; min-label steps with pointer jumping."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def _sound(e: F.Column) -> F.Column:
    odd = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col("label").isNotNull() & e.isNotNull() & (F.size(e) > 0) & ~odd & F.exists(e, lambda x: x != 0)


_LINKS = "a long, b long, n long, open boolean, low int, high int, tile int"


def _links(rows: pd.DataFrame, threshold: float, again: bool) -> pd.DataFrame:
    """What a pair of tiles gives: (a, null, n) for class a, linked with n vectors of other classes; (a, b, null), edges of a
    spanning forest; with open set, classes that have an undecided pair. Again: of the undecided pairs only, in double precision."""
    low, high = int(rows["low"].iloc[0]), int(rows["high"].iloc[0])
    sides = [rows[rows["tile"] == t] for t in ([low] if low == high else [low, high])]
    out = {c: [] for c in ("a", "b", "n", "open", "tile")}
    if all(map(len, sides)):
        of = [Quantised(np.frombuffer(b"".join(x["q"]), np.int8).reshape(len(x), -1), *(x[c].to_numpy() for c in _QUANTISED[1:])) for x in sides]
        ids, n, tile = (np.concatenate([x[c].to_numpy() for x in sides]) for c in ("cid", "n", "tile"))
        full = [np.stack(x["embedding"].to_numpy()) for x in sides] if again else None
        count, label, left, shift = np.zeros(len(ids)), np.arange(len(ids)), np.zeros(len(ids), bool), len(of[0].q) if len(of) > 1 else 0
        for i, j, sure in decided(of[0], of[-1], threshold):
            keep = i < j if low == high else slice(None)
            i, j, sure = i[keep], j[keep], sure[keep]
            if again:
                i, j = i[~sure], j[~sure]
                yes = exact(full[0], full[-1], i, j, threshold)
            else:
                yes = sure
                left[i[~sure]] = left[j[~sure] + shift] = True
            i, j = i[yes], j[yes] + shift
            count += np.bincount(i, n[j], len(ids)) + np.bincount(j, n[i], len(ids))
            label = spanning(len(ids), np.concatenate((i, np.arange(len(ids)))), np.concatenate((j, label)))
        one, two, three = np.flatnonzero(count), np.flatnonzero(label != np.arange(len(ids))), np.flatnonzero(left)
        none = lambda x: [None] * len(x)
        for x, b, k, o in ((one, none(one), count[one].astype(np.int64).tolist(), False), (two, ids[label[two]].tolist(), none(two), False), (three, none(three), none(three), True)):
            for c, v in zip(out, (ids[x].tolist(), b, k, [o] * len(x), tile[x].tolist()), strict=True):
                out[c] += v
    return pd.DataFrame({"a": pd.array(out["a"], "Int64"), "b": pd.array(out["b"], "Int64"), "n": pd.array(out["n"], "Int64"), "open": pd.array(out["open"], bool), "low": low, "high": high, "tile": pd.array(out["tile"], "int32")})


def class_links(classes: DataFrame, threshold: float, tile: int = TILE) -> DataFrame:
    """classes(cid, label, embedding, n) -> rows (a, b, n): for a class a the linked vectors of other classes n (b null), and edges a-b of a spanning forest (n null)."""
    spark = classes.sparkSession
    small_batches(spark)
    fields = [classes.schema["cid"], classes.schema["n"], classes.schema["label"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e, out = b.column("embedding"), [None] * b.num_rows
            size, flat, start = np.diff(e.offsets.to_numpy()), e.values.to_numpy(), e.offsets.to_numpy()
            for d in np.unique(size).tolist():
                at = np.flatnonzero(size == d)
                got = quantise(flat[start[at][:, None] + np.arange(d)])
                for i, row in zip(at.tolist(), zip(map(bytes, got.q), *(x.tolist() for x in got[1:]), strict=True), strict=True):
                    out[i] = row
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(columns[0], pa.binary()), *(pa.array(c, pa.float64()) for c in columns[1:])], names=["cid", "n", "label", *_QUANTISED])

    small = classes.select("cid", "n", "label", "embedding").mapInArrow(run, StructType([*fields, StructField("q", BinaryType()), *(StructField(c, DoubleType()) for c in _QUANTISED[1:])]))
    small = written(spark, small.withColumn("size", F.octet_length("q")), "quantised")
    group, columns = ["label", "size"], ["cid", "n", *_QUANTISED, "label", "size"]
    tiles = small.groupBy(group).agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("tiles"))
    dealt = small.join(tiles, group).withColumn("tile", F.pmod(F.xxhash64("cid"), F.col("tiles")).cast("int"))
    dealt = dealt.select(*columns, "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    dealt = dealt.select(*columns, "tile", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"))
    first = written(spark, dealt.groupBy(*group, "low", "high").applyInPandas(lambda x: _links(x, threshold, False), _LINKS), "tile-links")
    undecided = first.where("open").select(F.col("a").alias("cid"), "low", "high", "tile").join(small, "cid").join(classes.select("cid", "embedding"), "cid")
    second = undecided.groupBy(*group, "low", "high").applyInPandas(lambda x: _links(x, threshold, True), _LINKS)
    out = written(spark, first.where("not open").unionByName(second).select("a", "b", "n"), "links")
    for t in (small, first):
        drop_path(spark, t._brindle_path)
    return out


def near_duplicates(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id and kept for each vector; only equal labels are compared."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    sound = _sound(F.col("embedding"))
    classes = rows.where(sound).groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    classes = written(spark, classes.withColumn("cid", F.monotonically_increasing_id()), "classes")  # written: the numbers stay
    found = class_links(classes, threshold)
    joined = components(found.where("b is not null").select("a", "b"))
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("others"))
    of = classes.select("cid", "least", "n").join(joined, F.col("cid") == F.col("node"), "left").select("cid", "least", "n", F.coalesce("component", "cid").alias("component"))
    of = of.join(counts, F.col("cid") == F.col("a"), "left").select("cid", "least", "component", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    of = of.join(of.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("cid", "n_links", "component_id")
    of = of.join(classes.select("cid", "label", "embedding"), "cid").drop("cid")
    out = rows.withColumn("sound", sound).join(of.withColumn("sound", F.lit(True)), ["sound", "label", "embedding"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
