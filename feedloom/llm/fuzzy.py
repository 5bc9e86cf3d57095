"""Document fingerprints by context-triggered piecewise hashing.

A hash rolls over the bytes of a text; where it hits a value that the block size
sets, a piece ends, and each piece leaves one character of a signature. The block
size is 3 times a power of two that makes about 32 to 64 pieces of the text's
length, and a fingerprint holds the signatures at this size and at twice it:
`size:signature:signature`. Two fingerprints are compared at a block size that both
have, by the edit distance of the signatures (insertions and deletions cost 1, a
substitution both), where these share a run of characters; else they aren't alike.

Next documents come from one range-partitioned shuffle: ids are cut into ranges,
every range also gets the first document of the range below, and the last range
the first document of all. Each task then reads its ranges in order, two documents
at a time.

Defined results: null counts as the empty text, fingerprint `3::`; equal
fingerprints are alike by 1, an empty signature and another by 0. Documents are
ordered by descending id, those with one id by text, null ids last; a single
document is next to itself. A signature ends with the piece that begins at its
SIGNATURE-th character, which then holds the rest of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced
from pyspark.sql import types as T

WINDOW, LEAST_BLOCK, PIECES, SIGNATURE, RUN = 7, 3, 64, 128, 4
RANGE_ROWS, MOST_RANGES = 3_000, 20_000
ALPHABET = np.array([bytes([c]) for c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"])
PRIME = 0x100000001B3
INVERSE = pow(PRIME, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base to the powers 0..n-1, modulo 2**64; kept up to a million, which longer texts exceed for themselves alone."""
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 16), base, np.uint64)
        held[0] = 1
        held = np.multiply.accumulate(held)
        if n <= 1 << 20:
            _POWERS[base] = held
    return held[:n]


def fingerprint(data: bytes) -> str:
    n = len(data)
    block = LEAST_BLOCK
    while block * PIECES < n:
        block *= 2
    if not n:
        return f"{block}::"
    b = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    roll = np.zeros(n, np.uint64)
    for k in range(min(WINDOW, n)):
        roll[k:] += b[: n - k] * np.uint64(pow(0x9E3779B1, k + 1, 1 << 64))
    roll ^= roll >> np.uint64(29)
    roll = (roll * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)
    sums = np.cumsum(b * _powers(PRIME, n), dtype=np.uint64)
    undo = _powers(INVERSE, n)
    ends = np.flatnonzero(roll % np.uint64(block) == block - 1)
    double = ends[roll[ends] % np.uint64(2 * block) == 2 * block - 1]
    return f"{block}:{_signature(sums, undo, ends, n)}:{_signature(sums, undo, double, n)}"


def _signature(sums: np.ndarray, undo: np.ndarray, ends: np.ndarray, n: int) -> str:
    ends = ends[: SIGNATURE - 1]
    if not len(ends) or ends[-1] != n - 1:
        ends = np.append(ends, n - 1)
    starts = np.concatenate([[0], ends[:-1] + 1])
    before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    h = (sums[ends] - before) * undo[starts]
    h ^= h >> np.uint64(32)
    h = (h * np.uint64(0x94D049BB133111EB)) >> np.uint64(58)
    return b"".join(ALPHABET[h.astype(np.int64)].tolist()).decode()


def common_length(a: str, b: str) -> int:
    """The length of the longest common subsequence, by bits."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    every = (1 << len(a)) - 1
    v = every
    for c in b:
        u = v & places.get(c, 0)
        v = (v + u | v - u) & every
    return len(a) - v.bit_count()


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    run = min(RUN, len(a), len(b))
    if not run or not {a[i : i + run] for i in range(len(a) - run + 1)} & {b[i : i + run] for i in range(len(b) - run + 1)}:
        return 0.0
    return 2.0 * common_length(a, b) / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """How alike two fingerprints are, from 0 to 1."""
    if a == b:
        return 1.0
    (m, a1, a2), (n, b1, b2) = a.split(":"), b.split(":")
    if m == n:
        return max(_alike(a1, b1), _alike(a2, b2) if len(a2) > RUN and len(b2) > RUN else 0.0)
    if int(m) == 2 * int(n):
        return _alike(a1, b2)
    return _alike(a2, b1) if int(n) == 2 * int(m) else 0.0


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, fingerprint of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            arrays = [batch.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array([fingerprint(t.encode()) for t in texts])]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_chars", "fingerprint"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_chars long, fingerprint string")


def in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """range, extra, doc_id, text: partitions hold whole ranges, each in descending order and then, marked
    extra, the document that comes next after the range."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = rows.select("doc_id")
    count = ids.count()
    ranges = min(MOST_RANGES, max(1, count // RANGE_ROWS))
    shares = [i / ranges for i in range(1, ranges)]
    found = ids.agg(F.percentile_approx("doc_id", shares, 100 * ranges).alias("cuts")).first().cuts if shares else None
    cuts = np.array(sorted(set(found or [])))

    @F.pandas_udf(T.IntegerType())
    def range_of(x: pd.Series) -> pd.Series:
        at = len(cuts) - np.searchsorted(cuts, x.fillna(0).to_numpy(), side="right")
        return pd.Series(np.where(x.isna(), len(cuts) + 1, at))

    # one row per range, at most MOST_RANGES + 1 of them
    firsts = ids.groupBy(range_of("doc_id").alias("range")).agg(F.max("doc_id").alias("doc_id"), F.count("doc_id").alias("known")).collect()
    firsts = sorted(firsts, key=lambda r: r.range)
    follows = [(firsts[i - 1].range, firsts[i].doc_id) for i in range(len(firsts))]
    spark = docs.sparkSession
    target = F.broadcast(spark.createDataFrame(follows, f"range int, doc_id {rows.schema['doc_id'].dataType.simpleString()}"))
    extra = (
        rows.join(target, rows["doc_id"].eqNullSafe(target["doc_id"]))
        .groupBy("range", rows["doc_id"])
        .agg(F.min("text").alias("text"))
        .select("range", F.lit(1).alias("extra"), "doc_id", "text")
    )
    own = rows.select(range_of("doc_id").alias("range"), F.lit(0).alias("extra"), "doc_id", "text")
    parts = max(len(firsts), 1)
    return (
        own.unionByName(extra)
        .repartition(parts, "range")
        .sortWithinPartitions("range", "extra", F.col("doc_id").desc_nulls_last(), "text")
    )


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in sliced(batches):
            out: list[tuple] = []
            for rng, extra, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                own = fingerprint(text.encode())
                if held is not None and held[0] == rng:
                    _, before, old, print_ = held
                    k = len(old) // 2
                    edited = (old[: len(old) - k] + text[:k]).encode()
                    new = fingerprint(edited)
                    sha = hashlib.sha256(edited).hexdigest()
                    out.append((before, len(old), sha, print_, new, likeness(print_, new), likeness(print_, own)))
                held = None if extra else (rng, doc_id, text, own)
            columns = list(zip(*out)) or [()] * 7
            kinds = (batch.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    rows = in_order(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run,
        f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
