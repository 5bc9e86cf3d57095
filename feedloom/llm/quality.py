"""Quality classification by a regularised quadratic discriminant.

Every text gives a vector of transformed statistics. Each class has a Gaussian
whose covariance is shrunk, first towards the classes' pooled covariance and then
towards a sphere; its Cholesky factor is inverted once and kept. A score is the
logistic of the difference of the two log densities, which are Mahalanobis
distances and log determinants, and of the classes' log shares.

All labelled rows are learned from: tasks sum their vectors and outer products, and
Spark adds those sums up by class and place.

Defined results: null counts as the empty text, which has a vector and so a score;
labels other than 0 and 1, null and rows without text's id teach nothing; several
labels of one id all count; with fewer than two rows of a class the score is the
share of class 1, or 0.5 without any label; rows and ids may repeat.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, sliced

STATISTICS = (
    "log_chars", "log_words", "word_length", "word_spread", "alpha", "digit", "mark", "upper", "distinct", "top_word",
    "log_lines", "repeated_lines", "packed", "no_letter_words", "ends", "line_length", "marked_words", "stop_rate",
)
POOL, SPHERE, LIMIT = 0.6, 0.02, 8.0
LETTERS, DIGITS, UPPER, MARKS = (re.compile(p) for p in (r"[^\W\d_]", r"\d", r"[A-ZÀ-ÖØ-Þ]", r"[^\w\s]"))
ENDS, MARKED = re.compile(r"[.!?](?:\s|$)"), re.compile(r"[^\w\s.,;:]+(?:\s|$)")


def _share(part: float, whole: float) -> float:
    """The arcsine of the root of a share: spread even near 0 and 1."""
    return math.asin(math.sqrt(min(1.0, part / whole))) if whole else 0.0


def statistics(text: str | None) -> list[float]:
    """The vector of a text, in the order of STATISTICS."""
    text = text or ""
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, w = len(text), len(words)
    sizes = np.fromiter(map(len, words), float, w) if w else np.zeros(1)
    letters = n - len(LETTERS.sub("", text))
    counts = Counter(x.lower() for x in words)
    data = text.encode()
    return [
        math.log1p(n),
        math.log1p(w),
        math.log1p(sizes.mean()),
        math.log1p(sizes.std()),
        _share(letters, n),
        _share(n - len(DIGITS.sub("", text)), n),
        _share(n - len(MARKS.sub("", text)), n),
        _share(n - len(UPPER.sub("", text)), letters),
        math.log1p(len(counts)) / math.log(2 + w),
        _share(max(counts.values(), default=0), w),
        math.log1p(len(lines)),
        _share(len(lines) - len(set(lines)), len(lines)),
        len(_packer().compress(data)) / (len(data) + 20.0),
        _share(sum(1 for x in words if not LETTERS.search(x)), w),
        _share(len(ENDS.findall(text)), w),
        math.log1p(n / max(1, len(lines))),
        _share(len(MARKED.findall(text)), w),
        _share(sum(c for x, c in counts.items() if len(x) <= 3), w),
    ]


_PACKERS: list[zstandard.ZstdCompressor] = []


def _packer() -> zstandard.ZstdCompressor:
    if not _PACKERS:
        _PACKERS.append(zstandard.ZstdCompressor(level=1))
    return _PACKERS[0]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, x: the vector of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, x array<double>")


class Discriminant:
    """Class shares, means and inverted Cholesky factors."""

    def __init__(self, sums: dict[int, np.ndarray], size: int = len(STATISTICS), pool: float = POOL, sphere: float = SPHERE):
        """sums: by class the number of rows, their sum and the sum of their outer products, in one vector."""
        n = {c: s[0] for c, s in sums.items()}
        total = sum(n.values())
        self.share = n.get(1, 0.0) / total if total else 0.5
        self.parts = None
        if min(n.get(0, 0), n.get(1, 0)) < 2:
            return
        means = {c: s[1 : 1 + size] / n[c] for c, s in sums.items()}
        spreads = {c: s[1 + size :].reshape(size, size) / n[c] - np.outer(means[c], means[c]) for c, s in sums.items()}
        pooled = sum(n[c] * spreads[c] for c in sums) / total
        self.scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
        self.parts = {}
        for c in sums:
            own = (1 - pool) * spreads[c] + pool * pooled
            own = own / np.outer(self.scale, self.scale)
            own = (1 - sphere) * own + sphere * np.eye(size) * max(1.0, np.trace(own) / size)
            factor = np.linalg.cholesky(own)
            constant = math.log(n[c] / total) - np.log(np.diag(factor)).sum()
            self.parts[c] = means[c] / self.scale, np.linalg.inv(factor), constant

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 for each row of x."""
        if self.parts is None:
            return np.full(len(x), self.share)
        middle = (self.parts[0][0] + self.parts[1][0]) / 2
        z = middle + np.clip(x / self.scale - middle, -LIMIT, LIMIT)
        log = {c: k - 0.5 * (((z - mean) @ inverse.T) ** 2).sum(1) for c, (mean, inverse, k) in self.parts.items()}
        return 1.0 / (1.0 + np.exp(np.clip(log[0] - log[1], -50, 50)))


def fit(vectors: DataFrame, labels: DataFrame) -> Discriminant:
    """From doc_id, x and doc_id, quality: the sums of each class, added up by Spark, are all that is collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        size = len(STATISTICS)
        for batch in sliced(batches):
            x = np.array(batch.column(1).to_pylist(), float).reshape(-1, size)
            y = np.array(batch.column(0).to_pylist(), int)
            for c in (0, 1):
                own = x[y == c]
                sums[c] = sums.get(c, 0) + np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        for c, s in sums.items():
            arrays = [pa.array([c] * len(s), pa.int32()), pa.array(range(len(s)), pa.int32()), pa.array(s, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, ["quality", "place", "value"])

    marked = labels.filter("quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality"))
    parts = vectors.join(marked, "doc_id").select("quality", "x").mapInArrow(run, "quality int, place int, value double")
    found: dict[int, np.ndarray] = {}
    for r in parts.groupBy("quality", "place").agg(F.sum("value").alias("value")).collect():
        found.setdefault(r.quality, np.zeros(1 + len(STATISTICS) * (1 + len(STATISTICS))))[r.place] = r.value
    return Discriminant({c: s for c, s in found.items() if s[0] > 0})


def score(vectors: DataFrame, model: Discriminant) -> DataFrame:
    """vectors with score in place of x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            x = np.array(batch.column(1).to_pylist(), float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x), pa.float64())], ["doc_id", "score"])

    kind = vectors.schema["doc_id"].dataType.simpleString()
    return vectors.select("doc_id", "x").mapInArrow(run, f"doc_id {kind}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, trained_on, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted of every row; trained_on is a condition on doc_id that learning keeps to."""
    vectors = materialize(document_statistics(docs), "quality-vectors")
    scored = score(vectors, fit(vectors.filter(trained_on), labels))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
