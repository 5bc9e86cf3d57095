"""Token counts by dynamic programming over a trie of pre-tokens.

A pre-token is a space and a word. The distinct pre-tokens of a task go into a trie
of bytes; every node holds the best unigram score of its prefix and the number of
pieces on that way, worked out once from the nodes above it when the node is made,
so pre-tokens that begin alike share the work. What stands at a pre-token's last
node is stored as its count, and a document's count is the sum over its words.

The unigram model takes the pieces of a public vocabulary file, in its order, with
Zipf-Mandelbrot probabilities; a byte outside any piece is a token of its own, less
likely than all pieces. Of equal scores the way with fewer pieces counts.

A trie is emptied at NODES nodes, and words of over LONG bytes run through the same
recurrence without entering it, so a task's memory has a bound.

Defined results: null and texts without words have 0 words, 0 tokens and score 0;
rows and ids may repeat. Only the id and the text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import model_file, release, sliced

NODES, LONG, SHIFT = 500_000, 64, 2.7


class Unigram:
    """Scores of pieces as bytes, a leading space standing for the space sign."""

    def __init__(self, pieces: list[bytes]):
        weights = [1.0 / (i + SHIFT) for i in range(len(pieces) + 256)]
        total = sum(weights)
        self.scores: dict[bytes, float] = {}
        for piece, weight in zip(pieces, weights):
            self.scores.setdefault(piece, math.log(weight / total))
        self.byte = math.log(weights[-1] / total)
        self.reach: dict[bytes, int] = {}  # the longest piece that ends in these two bytes
        for piece in pieces:
            self.reach[piece[-2:]] = max(len(piece), self.reach.get(piece[-2:], 1))

    @classmethod
    def of_model(cls, path: str) -> Unigram:
        from sentencepiece import sentencepiece_model_pb2

        with open(model_file(path), "rb") as f:
            model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        return cls([p.piece.replace("▁", " ").encode() for p in model.pieces if p.type == 1])

    def step(self, word: bytes, end: int, best: list[float], count: list[int]) -> tuple[float, int]:
        """The best score and count of word[:end], from those of all shorter prefixes."""
        get = self.scores.get
        top, fewest = best[end - 1] + self.byte, count[end - 1] + 1
        for start in range(end - 1, max(0, end - self.reach.get(word[max(0, end - 2) : end], 1)) - 1, -1):
            own = get(word[start:end])
            if own is not None:
                value = best[start] + own
                if value > top or value == top and count[start] + 1 < fewest:
                    top, fewest = value, count[start] + 1
        return top, fewest


class Trie:
    """Prefixes of pre-tokens with their best scores and counts, and terminals: pre-token -> (count, score)."""

    def __init__(self, model: Unigram):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best, self.count = [0.0], [0]
        self.terminals: dict[bytes, tuple[int, float]] = {}

    def insert(self, word: bytes) -> tuple[int, float]:
        if len(self.best) >= NODES:
            self.clear()
        node, best, count = 0, [0.0], [0]
        for end, byte in enumerate(word, 1):
            key = node << 8 | byte
            node = self.child.get(key, -1)
            if node < 0:
                top, fewest = self.model.step(word, end, best, count)
                node = self.child[key] = len(self.best)
                self.best.append(top)
                self.count.append(fewest)
            best.append(self.best[node])
            count.append(self.count[node])
        found = self.terminals[word] = count[-1], best[-1]
        return found

    def outside(self, word: bytes) -> tuple[int, float]:
        """The same for a long word, kept nowhere."""
        best, count = [0.0], [0]
        for end in range(1, len(word) + 1):
            top, fewest = self.model.step(word, end, best, count)
            best.append(top)
            count.append(fewest)
        return count[-1], best[-1]

    def tokens(self, text: str | None) -> tuple[int, int, float]:
        """Words, tokens and score of a text."""
        words, tokens, score = (text or "").encode().split(), 0, 0.0
        for word in words:
            pre = b" " + word
            n, s = self.terminals.get(pre) or (self.insert(pre) if len(pre) <= LONG else self.outside(pre))
            tokens += n
            score += s
        return len(words), tokens, score


@lru_cache(maxsize=2)
def trie(path: str) -> Trie:
    return Trie(Unigram.of_model(path))


def count_tokens(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens, score of every row, under the pieces of the vocabulary file at `model`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = trie(model)
        for batch in sliced(batches):
            columns = list(zip(*map(t.tokens, batch.column(1).to_pylist())))
            arrays = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n_words", "n_tokens", "score"])
        t.clear()
        release()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(
        run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long, score double"
    )
