"""Nearest neighbours beyond one cycle: an index of inverted lists round coarse centroids.

Centroids are fitted on a bounded sample, the SAMPLE rows whose keys' hashes are least;
every row is in the list of its nearest centroid. A query looks into the lists of its
`probes` nearest centroids and scores all that is there exactly, so what it finds is
right and only what lies in other lists is missed. How many lists that must be is measured
on the sample: as many as hold TARGET of the nearest neighbours of ASKED of its rows.
Vectors without any structure need most lists, clustered ones a few. Lists are dealt to blocks of rows,
queries to blocks of queries, so a list that holds a third of all rows is many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from feedloom.operators.similarity import BLOCK, _nearest

#: Rows on which centroids are fitted, the most centroids, rounds of the fit.
SAMPLE, MOST_LISTS, ROUNDS = 20_000, 4_096, 12
#: The share of true neighbours that probed lists must hold in the sample, rows of it that are asked, neighbours of each.
TARGET, ASKED, NEAREST = 0.95, 512, 10


def fit(rows: DataFrame, lists: int | None = None, key: str = "candidate_id", vector: str = "vector") -> tuple[np.ndarray, int]:
    """Unit centroids by spherical k-means on the sample, as many as the root of the rows' number, MOST_LISTS at most; and the probes that it takes."""
    sample = rows.select(key, F.transform(vector, lambda x: x.cast("double")).alias("v")).orderBy(F.xxhash64(key), key).limit(SAMPLE)
    x = np.array([r.v for r in sample.select("v").toLocalIterator()])
    if not len(x):
        return np.zeros((0, 0)), 1
    k = min(lists or math.ceil(math.sqrt(rows.count())), MOST_LISTS, len(x))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    centroids = x[:k].copy()
    for _ in range(ROUNDS):
        own = np.argmax(x @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        lengths = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(lengths > 1e-12, sums / np.maximum(lengths, 1e-300), centroids)
    asked = x[:ASKED]
    sims = asked @ x.T
    sims[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    near = np.argsort(-sims, axis=1)[:, :NEAREST]
    own = np.argmax(x @ centroids.T, axis=1)
    rank = np.argsort(np.argsort(-(asked @ centroids.T), axis=1), axis=1)
    return centroids, int(np.quantile(np.take_along_axis(rank, own[near], axis=1), TARGET, method="higher")) + 1


@dataclass
class ListIndex:
    """rows: list, key, vector of every row; sizes: list, n; probes: lists that a query looks into."""

    centroids: np.ndarray
    probes: int
    rows: DataFrame
    sizes: DataFrame

    def neighbours(self, queries: DataFrame, k: int, floor: float = -math.inf, probes: int | None = None, key: str = "candidate_id", vector: str = "vector") -> DataFrame:
        """query, other, sim: of each query the k nearest others in the lists it looks into, none below the floor, the least key first on ties."""
        asked = placed(queries, self.centroids, probes or self.probes, key, vector)
        rows = F.greatest(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int")
        sizes = self.sizes.select("list", rows.alias("parts"))
        counted = asked.groupBy("list").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.lit(1)).cast("int").alias("groups")).join(F.broadcast(sizes), "list")
        # at most MOST_LISTS rows of both tables, so they may go to every task
        mine = self.rows.join(F.broadcast(counted), "list").withColumn("part", F.pmod(F.xxhash64("key"), "parts").cast("int"))
        mine = mine.select("list", "part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), "key", "vector")
        theirs = asked.join(F.broadcast(counted), "list").withColumn("group", F.pmod(F.xxhash64("key", F.lit(1)), "groups").cast("int"))
        theirs = theirs.select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "group", "key", "vector")
        choose, schema = _nearest(k, floor), pa.schema([("query", pa.int64()), ("other", pa.int64()), ("sim", pa.float64())])

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return schema.empty_table()
            a, b = (np.asarray(t.column("key")) for t in (left, right))
            x, y = (t.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1) for t in (left, right))
            return pa.Table.from_arrays([pa.array(c) for c in choose(a, b, x, y)], schema=schema)

        where = ["list", "part", "group"]
        met = theirs.groupBy(*where).cogroup(mine.groupBy(*where)).applyInArrow(run, "query long, other long, sim double")
        near = W.partitionBy("query").orderBy(F.desc("sim"), "other")
        return met.withColumn("place", F.row_number().over(near)).filter(F.col("place") <= k).drop("place")


def placed(rows: DataFrame, centroids: np.ndarray, probes: int, key: str, vector: str) -> DataFrame:
    """list, key, vector: each row in the lists of its nearest centroids, at unit length."""
    probes = max(1, min(probes, len(centroids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            near = np.argpartition(-(x @ centroids.T), probes - 1, axis=1)[:, :probes]
            at = pa.array(np.repeat(np.arange(len(x)), probes))
            flat = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), batch.column(0).take(at), flat.take(at)], names=["list", "key", "vector"])

    doubles = rows.select(F.col(key).cast("long").alias("key"), F.transform(vector, lambda c: c.cast("double")).alias("vector"))
    return doubles.mapInArrow(run, "list int, key long, vector array<double>")


def build(rows: DataFrame, lists: int | None = None, key: str = "candidate_id", vector: str = "vector") -> ListIndex:
    """An index of every row. Vectors are of one length and not null."""
    centroids, probes = fit(rows, lists, key, vector)
    listed = placed(rows, centroids, 1, key, vector)
    return ListIndex(centroids, probes, listed, listed.groupBy("list").agg(F.count(F.lit(1)).alias("n")))


def near_pairs(fresh: DataFrame, earlier: DataFrame, floor: float = 0.6, neighbours: int = 3, probes: int | None = None, key: str = "candidate_id") -> DataFrame:
    """a, b, sim: each fresh story's nearest among fresh and earlier ones, above the floor, every pair once: candidates for one event.

    Two earlier stories never make a pair, as they have met before."""
    index = build(fresh.select(key, "vector").unionByName(earlier.select(key, "vector")), key=key)
    found = index.neighbours(fresh, neighbours, floor, probes, key)
    return found.select(F.least("query", "other").alias("a"), F.greatest("query", "other").alias("b"), "sim").dropDuplicates(["a", "b"])
