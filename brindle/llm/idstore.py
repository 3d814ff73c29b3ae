"""Token ids in Parquet list columns that can be read selectively.

Texts are range-partitioned and sorted by doc_id before they are encoded, so only texts are shuffled and the files hold
the ids in ascending doc_id order. File format: Parquet v2, a row a document:

    part int          the file's place in the order (range partitions in order)
    doc_id long       delta encoded (sorted)
    start_in_part long, n_tokens long   delta encoded
    ids array<int>    dictionary encoded while a row group has few distinct ids, else delta encoded

with row groups of ROW_GROUP_BYTES, pages of at most PAGE_ROWS rows, and column and offset indexes for each page, so a
reader can take metadata without ids, or the pages of some doc_ids only.

Defined cases: a null or empty text has only the end id; rows of equal doc_id keep an order by text; null doc_ids come
first; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch, gathered, new_path, small_batches

ROW_GROUP_BYTES, PAGE_ROWS = 32 << 20, 500
#: Pieces of text whose ids a worker remembers.
PIECES = 600_000
#: Bytes of text that are split and encoded together.
TOGETHER = 8 << 20
#: What may follow the letters of a chunk; a run of these is one piece to the tokenizer.
TAIL = b".,;:!?*$%&#"
SCHEMA = "part int, doc_id long, start_in_part long, n_tokens long, ids array<int>"
ARROW = pa.schema([pa.field("part", pa.int32()), pa.field("doc_id", pa.int64()), pa.field("start_in_part", pa.int64()), pa.field("n_tokens", pa.int64()), pa.field("ids", pa.list_(pa.int32()))])


class ChunkEncoder:
    """A BPE tokenizer of the tokenizers library that drops white space, marks word ends and lower-cases, asked once for each distinct piece.

    Chunks are what stands between ASCII white space, which the library drops as well. Most are letters and then
    punctuation: two pieces, and the library encodes many of them in one text, where each ends with an id that marks a
    word's end. All other chunks go to it as they are, joined by a special token of its own whose id marks the borders.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.of = Tokenizer.from_file(path)
        self.border_id, border = min((i, t.content) for i, t in self.of.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word))
        self.border = border.encode()
        self.ends = np.zeros(self.of.get_vocab_size(), bool)
        self.ends[[i for t, i in self.of.get_vocab().items() if t.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {b"": b""}

    def _ids(self, text: bytes) -> np.ndarray:
        return np.array(self.of.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, "<u4")

    def _cut(self, parts: list[bytes], ids: np.ndarray, ends: np.ndarray, gap: int) -> dict[bytes, bytes]:
        flat, starts = ids.tobytes(), np.concatenate(([0], ends[:-1] + gap))
        return dict(zip(parts, [flat[a:b] for a, b in zip((starts * 4).tolist(), (ends * 4).tolist(), strict=True)], strict=True))

    def _encode(self, parts: list[bytes], plain: bool, step: int = 1000) -> dict[bytes, bytes]:
        out: dict[bytes, bytes] = {}
        for k in range(0, len(parts), step):
            part = parts[k : k + step]
            if plain:
                ids = self._ids(b"\n".join(part))
                if len(at := np.flatnonzero(self.ends[ids]) + 1) == len(part):
                    out |= self._cut(part, ids, at, 0)
                    continue
            ids = self._ids(self.border.join(part))
            if len(at := np.flatnonzero(ids == self.border_id)) == len(part) - 1:
                out |= self._cut(part, ids, np.append(at, len(ids)), 1)
            else:  # the special token stands in a chunk
                out |= {c: self._ids(c).tobytes() for c in part}
        return out

    def _of_chunks(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of distinct chunks."""
        known = self.known
        heads, tails, odd = [], [], []
        for c in chunks:
            head = c.rstrip(TAIL)
            if head.isalpha():  # ASCII letters
                heads.append(head.lower())
                tails.append(c[len(head) :])
            elif not head:
                heads.append(b"")
                tails.append(c)
            elif c in known:
                heads.append(c)
                tails.append(b"")
            elif (word := head.decode()).isalpha() and (lower := word.lower()).isalpha() and len(lower) == len(word) and is_normalized("NFC", word):
                heads.append(head)
                tails.append(c[len(head) :])
            else:
                odd.append(c)
                heads.append(c)
                tails.append(b"")
        new = set(heads).union(tails).difference(known, odd)
        learnt = self._encode(list(new), True) | self._encode(odd, False)
        known |= learnt
        out = [known[a] + known[b] if b else known[a] for a, b in zip(heads, tails, strict=True)]
        if len(known) > PIECES:  # what came first stays: it is the frequent
            for c in learnt:
                del known[c]
        return out

    def encode(self, docs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: none) one after another, and how many each text has."""
        split = pc.ascii_split_whitespace(docs.cast(pa.large_string()))
        words = split.flatten().dictionary_encode()
        ids = self._of_chunks(words.dictionary.cast(pa.large_binary()).to_pylist())
        flat = np.frombuffer(b"".join(ids), "<u4")
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        start = np.cumsum(size) - size
        at = words.indices.to_numpy()
        sizes = size[at]
        ends = np.cumsum(sizes)
        take = np.repeat(start[at] - (ends - sizes), sizes)
        take += np.arange(len(take))
        per_doc = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(split), 0).to_numpy())))]
        return flat[take], np.diff(per_doc)


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def write(docs: DataFrame, tokenizer: str, end_id: int, path: str) -> None:
    """Writes the ids of all texts, each followed by end_id, in ascending doc_id order."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, start = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for b in gathered(batches, TOGETHER):
            ids, sizes = enc.encode(b.column("text"))
            at = np.cumsum(sizes)
            ids, sizes = np.insert(ids, at, end_id), sizes + 1
            ends = np.cumsum(sizes)
            column = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids.astype("<u4").view("<i4")))
            yield batch(ARROW, np.full(len(sizes), part, np.int32), b.column("doc_id"), start + ends - sizes, sizes, column)
            start += int(sizes.sum())

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    options = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.block.size": str(ROW_GROUP_BYTES), "parquet.page.row.count.limit": str(PAGE_ROWS), "parquet.enable.dictionary": "true"}
    ordered.mapInArrow(run, SCHEMA).write.options(**options).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with start, the number of ids of all documents before; a row a part is broadcast, read without the ids."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    return rows.join(F.broadcast(parts), "part").select("doc_id", (F.col("part_start") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def checksums(stored: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of rows from read()."""
    schema = pa.schema([pa.field(n, pa.int64()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            flat, offsets = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
            yield batch(schema, b.column("doc_id"), b.column("start"), np.diff(offsets).astype(np.int64), [zlib.crc32(flat[i:j].tobytes()) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])

    return stored.select("doc_id", "start", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def stored(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Writes to a new place in the shared folder and reads it back."""
    spark = docs.sparkSession
    write(docs, tokenizer, end_id, path := new_path(spark, "ids"))
    return read(spark, path)
