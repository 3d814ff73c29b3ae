"""Token counts by linear longest-match: a vocabulary trie with failure links.

For each trie node the automaton keeps, for the case that no edge goes on, how many tokens the greedy longest match pops and
the node where matching goes on (Song et al., "Fast WordPiece Tokenization", 2021). A word's length in word pieces then
takes one walk over its characters; no piece is built. A worker walks each distinct word once;
texts are split and their words numbered by Arrow.

Words that cannot be split into pieces of the vocabulary count as one unknown token, as do words longer than max_chars if
that is given.

Defined cases: a null or empty text, or one of white space only, has no tokens; rows of equal doc_id give a row each; other
columns are not read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, gathered, small_batches

#: Words whose counts a worker remembers, and bytes of text that are split together.
WORDS, TOGETHER = 1_000_000, 8 << 20
NONE = -1


class MaxMatch:
    """initial: pieces that may start a word; inner: pieces that may follow, without their mark. The same set may be both."""

    def __init__(self, initial: set[str], inner: set[str], max_chars: int | None = None):
        self.max_chars = max_chars
        self.edges: dict[tuple[int, str], int] = {}
        children: list[list[tuple[str, int]]] = [[], []]
        final: list[bool] = [False, False]
        self.root, self.rest = 0, 1
        for root, pieces in ((self.root, initial), (self.rest, inner)):
            for piece in sorted(pieces):
                at = root
                for c in piece:
                    if (to := self.edges.get((at, c))) is None:
                        to = self.edges[at, c] = len(final)
                        children[at].append((c, to))
                        children.append([])
                        final.append(False)
                    at = to
                final[at] = at > 1
        self.fail, self.pops = [NONE] * len(final), [0] * len(final)
        todo = deque([self.root, self.rest])
        while todo:
            at = todo.popleft()
            for c, to in children[at]:
                if final[to]:
                    self.fail[to], self.pops[to] = self.rest, 1
                else:
                    z, pops = self.fail[at], self.pops[at]
                    while z != NONE and (z, c) not in self.edges:
                        pops += self.pops[z]
                        z = self.fail[z]
                    if z != NONE:
                        self.fail[to], self.pops[to] = self.edges[z, c], pops
                todo.append(to)
        self.known: dict[str, int] = {}

    def pieces(self, word: str) -> int:
        """How many pieces the greedy longest match gives."""
        if self.max_chars is not None and len(word) > self.max_chars:
            return 1
        at, count, edges, fail, pops = self.root, 0, self.edges, self.fail, self.pops
        for c in word:
            while (to := edges.get((at, c))) is None:
                count += pops[at]
                at = fail[at]
                if at == NONE:
                    return 1
            at = to
        while at != self.rest:
            count += pops[at]
            at = fail[at]
            if at == NONE:
                return 1
        return count

    def count(self, docs: pa.Array, mark: str) -> np.ndarray:
        """Pieces of each text (null: none); words stand between ASCII white space, and mark is put before each."""
        split = pc.ascii_split_whitespace(docs.cast(pa.large_string()))
        words = split.flatten().dictionary_encode()
        distinct, known = words.dictionary.to_pylist(), self.known
        new = {w: self.pieces(mark + w) if w else 0 for w in distinct if w not in known}
        known |= new
        sizes = np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))[words.indices.to_numpy()]
        if len(known) > WORDS:  # what came first stays: it is the frequent
            for w in new:
                del known[w]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        return np.diff(ends[np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(split), 0).to_numpy())))])


_automata: dict[str, MaxMatch] = {}


def automaton(model: str) -> MaxMatch:
    """The pieces of a sentencepiece model file, control and byte pieces left out: those with the word mark start a word."""
    if model not in _automata:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model)
        pieces = {sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        _automata[model] = MaxMatch({p for p in pieces if p.startswith(MARK)}, {p for p in pieces if not p.startswith(MARK)})
    return _automata[model]


#: The word mark of the vocabulary (a fixed value of its format).
MARK = "▁"


def token_counts(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and n_tokens, the word pieces of each text."""
    small_batches(docs.sparkSession)
    schema = pa.schema([pa.field("doc_id", pa.int64()), pa.field("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = automaton(model)
        for b in gathered(batches, TOGETHER):
            yield batch(schema, b.column("doc_id"), counter.count(b.column("text"), MARK))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long")
