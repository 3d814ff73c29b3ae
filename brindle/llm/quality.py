"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are of the whole text only (FEATURES). Trees are grown level by level on binned values: gradients and
Hessians of the log loss are summed into histograms, the best split of each node is read off their running sums. A fitted
model is four arrays (complete binary trees), which numpy walks for all rows of a batch at once.

Learning takes at most SAMPLE labels, those of least hash of doc_id, and of the documents that have them as many, those of
least hash of their statistics; so the driver holds a bounded matrix that no order of rows changes. All else covers all rows.

Defined cases: a null or empty text has all-zero statistics and gets a score; without labelled rows of both kinds every
score is the smoothed share of label 1; null labels, labels of one doc_id that differ, and doc_ids without a text are not
learnt from; a label that is repeated counts once, documents that repeat a doc_id count as rows; other columns are not read,
and a column kept by the name score, held_out or predicted is an error.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import as_row, batch, of_row, small_batches, texts

#: The bound of the labelled sample that is learnt from.
SAMPLE = 12_000
BINS, DEPTH, ROUNDS, RATE, L2, LEAST_HESSIAN = 64, 4, 60, 0.15, 1.0, 4.0
FEATURES = (
    "log_bytes", "log_words", "log_lines", "mean_word", "max_word", "upper", "lower", "digit", "space", "non_ascii", "period", "comma", "exclamation", "symbol", "bar", "bracket", "quote", "control",
    "distinct_words", "top_word", "top5_words", "once_words", "distinct_lines", "repeated_line_bytes", "mean_line", "words_by_sentence", "long_words", "short_words", "words_ending_odd", "words_upper",
)
_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t\n\r\x0b\x0c", "non_ascii": bytes(range(128, 256)), "period": b".", "comma": b",", "exclamation": b"!?", "symbol": b"#$%&*@^~+=_\\/", "bar": b"|", "bracket": b"()[]{}<>", "quote": b"\"'`", "control": bytes(range(9)) + bytes(range(14, 32))}
_MASKS = np.stack([np.isin(np.arange(256), list(v)) for v in _CLASSES.values()]).astype(np.float64)


def statistics(text: str) -> list[float]:
    """The FEATURES of a text, over all of it."""
    raw = text.encode()
    if not raw:
        return [0.0] * len(FEATURES)
    share = dict(zip(_CLASSES, (_MASKS @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256)) / len(raw), strict=True))
    words, lines = raw.split(), raw.split(b"\n")
    n, sizes = max(1, len(words)), np.fromiter(map(len, words), np.int64, len(words))
    counts = Counter(words)
    top = [c for _, c in counts.most_common(5)] or [0]
    of_lines = Counter(lines)
    odd = sum(c for w, c in counts.items() if w[-1:] in b"#$%&*@^~|+=<>!")
    loud = sum(c for w, c in counts.items() if w.isupper() and len(w) > 2)
    return [
        np.log1p(len(raw)), np.log1p(len(words)), np.log1p(len(lines)), float(sizes.sum()) / n, float(sizes.max(initial=0)), *share.values(),
        len(counts) / n, top[0] / n, sum(top) / n, sum(c == 1 for c in counts.values()) / n, len(of_lines) / len(lines), sum(len(x) * (c - 1) for x, c in of_lines.items()) / len(raw), len(raw) / len(lines),
        n / (1 + raw.count(b".")), float((sizes > 12).sum()) / n, float((sizes < 3).sum()) / n, odd / n, loud / n,
    ]


@dataclass
class Trees:
    """Complete trees of DEPTH: the children of node i are 2i+1 and 2i+2; value x goes right if x > threshold."""

    base: float
    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray
    value: np.ndarray  # (trees, leaves)

    def score(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1] if len(self.feature) else 0
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(inner + 1))):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - inner]
        return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    none = Trees(base, np.zeros((0, 0), np.int64), np.zeros((0, 0)), np.zeros((0, 0)))
    if not len(y) or y.min() == y.max():
        return none
    n, m = x.shape
    edges = np.quantile(x, np.arange(1, BINS) / BINS, axis=0).T  # (features, BINS - 1)
    bins = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(m)], axis=1)  # bin > k: x > edges[k]
    flat = bins + np.arange(m) * BINS
    margin, inner = np.full(n, base), 2**DEPTH - 1
    trees = []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node, feature, threshold = np.zeros(n, np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            key = ((node - first)[:, None] * (m * BINS) + flat).ravel()
            sums = [np.bincount(key, np.repeat(v, m), width * m * BINS).reshape(width, m, BINS) for v in (g, h)]
            left = [s.cumsum(2)[:, :, :-1] for s in sums]
            total = [s.sum(2, keepdims=True) for s in sums]
            right = [t - s for t, s in zip(total, left, strict=True)]
            gain = left[0] ** 2 / (left[1] + L2) + right[0] ** 2 / (right[1] + L2) - total[0] ** 2 / (total[1] + L2)
            gain[(left[1] < LEAST_HESSIAN) | (right[1] < LEAST_HESSIAN)] = 0
            best = gain.reshape(width, -1).argmax(1)
            f, b = best // (BINS - 1), best % (BINS - 1)
            good = gain.reshape(width, -1).max(1) > 1e-6
            feature[first : first + width] = f
            threshold[first : first + width] = np.where(good, edges[f, b], np.inf)
            at = node - first
            node = 2 * node + 1 + (good[at] & (bins[np.arange(n), f[at]] > b[at]))
        leaf = node - inner
        value = -RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + L2)
        margin += value[leaf]
        trees.append((feature, threshold, value))
    return Trees(base, *(np.stack(x) for x in zip(*trees, strict=True)))


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows that are never learnt from: crc32 of the id as text leaves 2 over 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Fits on a bounded sample of the labelled rows outside of held_out()."""
    small_batches(docs.sparkSession)
    chosen = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(F.col("quality").cast("double")).alias("y"))
    chosen = chosen.where("y in (0, 1)").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # at most `sample` rows of two numbers
    schema = pa.schema([pa.field("y", pa.float64()), pa.field("x", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(schema, b.column("y"), [statistics(t) for t in texts(b.column("text"))])

    # statistics where the texts lie; then the least rows by their values, whatever the order they come in
    rows = rows.select("y", "text").mapInArrow(run, "y double, x array<double>")
    got = rows.orderBy(F.xxhash64("x", "y"), "x", "y").limit(sample).toArrow()
    x = np.array(got.column("x").to_pylist(), np.float64).reshape(-1, len(FEATURES))
    y = got.column("y").to_numpy()
    order = np.lexsort((*x.T, y))
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Trees, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The columns keep of docs, and the score (0 to 1) as a column of that name."""
    small_batches(docs.sparkSession)
    rows = docs.select(as_row(docs, keep), F.col("text").cast("string").alias(name))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t) for t in texts(b.column(b.num_columns - 1))], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], names=["row", name])

    return rows.mapInArrow(run, StructType([rows.schema["row"], StructField(name, DoubleType())])).select(*of_row(keep), f"`{name}`")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep, held_out, score and predicted (1 if score >= threshold)."""
    if clash := {"held_out", "score", "predicted"}.intersection(keep):
        raise ValueError(f"columns that the result has itself: {sorted(clash)}")
    scored = score(docs, learn(docs, labels), keep)
    return scored.select(*keep, held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that are predicted as good, with all their columns."""
    name = "_score"
    while name in docs.columns:
        name += "_"
    return score(docs, learn(docs, labels), tuple(docs.columns), name).where(F.col(name) >= threshold).drop(name)
