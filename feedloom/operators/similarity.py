"""Exact similarity by blocks of vectors: pools, floors, assignment, neighbours, diversity.

Vectors meet as matrices: blocks of rows and a small set that goes to all of them, or stripes
of two large sets. Products of tiles of them give the similarities, of which only what
counts leaves the task: the best of a row, the nearest of a centroid.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from feedloom.functions.vector import unit

#: Vectors of a block; a set of up to so many bytes goes out whole, a larger one meets the rows' stripes in a shuffle.
BLOCK, BROADCAST_BYTES = 4_096, 1 << 20
#: Vectors of a stripe and the fewest worth a task; rows and others of a tile, whose similarities are in memory at once; slack within which they are ties.
STRIPE, LEAST_STRIPE, ROWS, TIE = 32_768, 512, 1_024, 1e-12
#: Vectors of a stripe where every pair leaves the task; others of a cycle of pairs; pairs at the head of a piece that are sorted by similarity.
PAIRED, CYCLE, ALIKE = 2_048, 256, 1 << 16
#: Interests of a profile.
LEAST_CLUSTERS, MOST_CLUSTERS = 8, 32


def packed(rows: DataFrame, key: str, vector: str, prefix: str = "") -> DataFrame:
    """Blocks of rows with their keys (longs), their number and one matrix of doubles; vectors are of one length, and rows without one are left out."""
    names = [f"{prefix}{x}" for x in ("keys", "n", "matrix")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                part = batch.slice(low, BLOCK)
                keys, flat = part.column(0), part.column(1).flatten()
                arrays = [pa.array([keys.to_pylist()], pa.list_(pa.int64())), pa.array([len(keys)], pa.int64())]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([flat.to_numpy(zero_copy_only=False).astype("<f8").tobytes()], pa.binary())], names)

    doubles = F.transform(vector, lambda x: x.cast("double"))
    return rows.filter(F.col(vector).isNotNull()).select(F.col(key).cast("long"), doubles).mapInArrow(run, f"{names[0]} array<long>, {names[1]} long, {names[2]} binary")


def blockwise(
    rows: DataFrame, others: DataFrame, key: str, other: str, choose: Callable[..., tuple], schema: str, vector: str = "vector", theirs: str = "their_vector", stripe: int = STRIPE
) -> DataFrame:
    """What `choose` gives for the keys and the matrices of two sets of vectors, piece by piece: columns of `schema`."""
    small = packed(others, other, theirs, "their_")
    size = small.agg(F.coalesce(F.sum(F.octet_length("their_matrix")), F.lit(0))).first()[0]
    if size > BROADCAST_BYTES:
        return _striped(rows, others, key, other, choose, schema, vector, theirs, stripe)
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, n, x, b, m, y = (c[i].as_py() for c in batch.columns)
                x, y = np.frombuffer(x, "<f8").reshape(n, -1), np.frombuffer(y, "<f8").reshape(m, -1)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in choose(np.array(a), np.array(b), x, y)], names)

    return packed(rows, key, vector).crossJoin(F.broadcast(small)).mapInArrow(run, schema)


def _striped(rows: DataFrame, others: DataFrame, key: str, other: str, choose: Callable[..., tuple], schema: str, vector: str, theirs: str, stripe: int) -> DataFrame:
    """The same for two large sets: both are dealt to stripes by their keys, and every two stripes meet in a group of their own."""

    def doubles(df: DataFrame, k: str, v: str) -> DataFrame:
        return df.filter(F.col(v).isNotNull()).select(F.col(k).cast("long").alias("k"), F.transform(v, lambda x: x.cast("double")).alias("v"))

    mine, their = doubles(rows, key, vector), doubles(others, other, theirs)
    n, m = mine.count(), their.count()
    down = max(1, math.ceil(n / stripe), min(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n / LEAST_STRIPE)))
    across = max(1, math.ceil(m / stripe))
    left = mine.select(F.pmod(F.xxhash64("k"), F.lit(down)).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))).alias("j"), "k", "v")
    right = their.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long"))).alias("i"), F.pmod(F.xxhash64("k"), F.lit(across)).alias("j"), "k", "v")
    kinds = {"long": pa.int64(), "double": pa.float64()}
    out = pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in schema.split(", "))])

    def run(one: pa.Table, two: pa.Table) -> pa.Table:
        if not one.num_rows or not two.num_rows:
            return out.empty_table()
        a, b = (t.column("k").to_numpy() for t in (one, two))
        x, y = (np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t.column("v").chunks]).reshape(t.num_rows, -1) for t in (one, two))
        return pa.Table.from_arrays([pa.array(c) for c in choose(a, b, x, y)], schema=out)

    # cells are few and their work isn't their bytes, so they are dealt by number
    cells, where = min(down * across, 2_000), ["i", "j"]
    return left.repartition(cells, *where).groupBy(*where).cogroup(right.repartition(cells, *where).groupBy(*where)).applyInArrow(run, schema)


def _best(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple:
    """Each row's best, and whose it is: the least key on ties."""
    order = np.argsort(b, kind="stable")
    b, y = b[order], y[order]
    best, whose = np.full(len(a), -np.inf), np.zeros(len(a), np.int64)
    for low in range(0, len(a), ROWS):
        for at in range(0, len(b), BLOCK):
            sims = x[low : low + ROWS] @ y[at : at + BLOCK].T
            most = sims.max(axis=1)
            first = np.argmax(sims >= (most - TIE)[:, None], axis=1)
            held = best[low : low + ROWS]
            better = np.flatnonzero(np.isnan(most) | (most > held + (TIE if at else 0)))
            held[better] = most[better]
            whose[low + better] = b[at + first[better]]
    return a, best, whose


def _nearest(k: int, floor: float = -np.inf):
    """Each row's k nearest others, the least key first on ties, without itself: by tiles, of which only what may be among the k is kept."""

    def choose(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple:
        order = np.argsort(b, kind="stable")
        b, y = b[order], y[order]
        own_from, own_to = np.searchsorted(b, a), np.searchsorted(b, a, side="right")
        out = []
        for low in range(0, len(a), ROWS):
            few = x[low : low + ROWS]
            least = np.full(len(few), floor)
            held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            for at in range(0, len(b), BLOCK):
                sims = few @ y[at : at + BLOCK].T
                first, last = (np.clip(p[low : low + ROWS] - at, 0, sims.shape[1]) for p in (own_from, own_to))
                for i in np.flatnonzero(first < last):
                    sims[i, first[i] : last[i]] = -np.inf
                found = (sims >= least[:, None]) & (sims > -np.inf)
                if k < sims.shape[1] and np.count_nonzero(found) > 4 * k * len(few):
                    found &= sims >= (np.partition(sims, -k, axis=1)[:, -k] - TIE)[:, None]
                i, j = np.nonzero(found)
                held = tuple(map(np.concatenate, zip(held, (i, b[at + j], np.round(sims[i, j], 12)))))
                held = tuple(c[_firsts(*held, k)] for c in held)
                # what comes later has larger keys, but is only rounded once it is kept
                full = np.flatnonzero(np.bincount(held[0], minlength=len(few)) == k)
                worst = np.full(len(few), np.inf)
                np.minimum.at(worst, held[0], held[2])
                least[full] = np.maximum(least[full], worst[full] - TIE)
            out.append((a[low + held[0]], held[1], held[2]))
        return tuple(map(np.concatenate, zip(*out))) if out else (a[:0], b[:0], np.zeros(0))

    return choose


def _firsts(rows: np.ndarray, keys: np.ndarray, sims: np.ndarray, k: int) -> np.ndarray:
    """Where each row's k largest are, the least key first on ties."""
    order = np.lexsort((keys, -sims, rows))
    begins = np.flatnonzero(np.r_[True, np.diff(rows[order]) != 0]) if len(rows) else np.zeros(0, np.int64)
    place = np.arange(len(rows)) - np.repeat(begins, np.diff(np.r_[begins, len(rows)]))
    return order[place < k]


def _all(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple:
    """Every row with every other, but not with itself, in an order that files hold in few bytes.

    A column gets a dictionary in a file if its first values repeat enough there, so the first rows are pairs whose rounded similarities
    do. From then on keys come in cycles, which hardly take any room, and a similarity takes the bits of its number in the dictionary."""
    sims = x @ y.T
    i, j = (np.concatenate(c) for c in zip(*(_cycle(len(a), at, min(at + CYCLE, len(b))) for at in range(0, max(len(b), 1), CYCLE))))
    differ = a[i] != b[j]
    i, j = i[differ], j[differ]
    out = sims[i, j]
    first = np.argsort(np.abs(out[:ALIKE] - np.median(out[:ALIKE]))) if len(out) else np.zeros(0, np.int64)
    for column in (i, j, out):
        column[:ALIKE] = column[:ALIKE][first]
    return a[i], b[j], out


def _cycle(n: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of n rows and the others from low to high."""
    return np.repeat(np.arange(n, dtype=np.int32), high - low), np.tile(np.arange(low, high, dtype=np.int32), n)


def similarities(rows: DataFrame, others: DataFrame, key: str, other: str) -> DataFrame:
    """key, other, sim of every row with every one of a stated set; a row doesn't meet itself. The result has a row for each pair."""
    return blockwise(rows, others, key, other, _all, f"{key} long, {other} long, sim double", stripe=PAIRED)


def label_means(vectors: DataFrame, label: str = "label", vector: str = "vector") -> DataFrame:
    """label, their_vector: each label's mean vector at length 1, a centroid that can be checked by SQL."""
    means = (
        vectors.select(label, F.posexplode(vector).alias("i", "x"))
        .groupBy(label, "i")
        .agg(F.avg(F.col("x").cast("double")).alias("m"))
        .groupBy(label)
        .agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("v"))
    )
    return means.select(label, unit(F.transform("v", lambda p: p["m"])).alias("their_vector"))


def cluster_count(points: int, fixed: int | None = None) -> int:
    """Interests of so many kept pages: about the root of half their number, 8 to 32, or a fixed number; never more than pages."""
    return max(1, min(fixed or min(MOST_CLUSTERS, max(LEAST_CLUSTERS, round(math.sqrt(points / 2)))), points))


def profile(pages: DataFrame, fixed: int | None = None, vector: str = "their_vector", dim: int | None = None) -> DataFrame:
    """centroid, n, their_vector: the interests of kept pages as unit centroids of k-means; no rows without pages.

    Pages whose vector is null, holds what is no number, or has another length than `dim` (a former model's) are left out."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    doubles = pages.select(F.transform(vector, lambda x: x.cast("double")).alias("v")).filter("v IS NOT NULL")
    fit = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    rows = doubles.filter(fit if dim is None else fit & (F.size("v") == dim)).select(array_to_vector("v").alias("features"))
    points = rows.count()
    if not points:
        return pages.sparkSession.createDataFrame([], "centroid long, n long, their_vector array<double>")
    model = KMeans(k=cluster_count(points, fixed), seed=0, maxIter=20).fit(rows)
    grouped = model.transform(rows).groupBy(F.col("prediction").cast("long").alias("centroid")).agg(
        F.count(F.lit(1)).alias("n"), Summarizer.mean(F.col("features")).alias("mean")
    )
    return grouped.select("centroid", "n", unit(vector_to_array("mean")).alias("their_vector"))


def knn_pool(candidates: DataFrame, centroids: DataFrame, k: int) -> DataFrame:
    """candidate_id, sim: exact top k of each centroid, positive similarities scaled by the centroid's weight,
    then a candidate's best. Exclusions come later, as the pool is of all candidates."""
    top = W.partitionBy("centroid").orderBy(F.desc("sim"), "candidate_id")

    def nearest(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple:
        centroid, candidate, sim = _nearest(k)(-1 - b, a, y, x)  # keys of two kinds are never the same
        return candidate, -1 - centroid, sim

    weights = centroids.select("centroid", "weight", F.max("weight").over(W.partitionBy(F.lit(1))).alias("heaviest"))
    pooled = blockwise(candidates, centroids, "candidate_id", "centroid", nearest, "candidate_id long, centroid long, sim double")
    pooled = pooled.withColumn("n", F.row_number().over(top)).filter(F.col("n") <= k).join(weights, "centroid")
    scaled = F.when(F.col("sim") > 0, F.col("sim") * (0.5 + 0.5 * F.col("weight") / F.col("heaviest"))).otherwise(F.col("sim"))
    return pooled.groupBy("candidate_id").agg(F.max(scaled).alias("sim"))


def best_similarity(rows: DataFrame, small: DataFrame, key: str = "candidate_id") -> DataFrame:
    """key, best: the largest similarity to the set, -1 at least, and where the set is empty or the row has no vector."""
    found = blockwise(rows, small.withColumn("__their", F.lit(0)), key, "__their", _best, f"{key} long, best double, their long")
    found = found.groupBy(key).agg(F.max("best").alias("best"))
    return rows.select(F.col(key).cast("long").alias(key)).join(found, key, "left").select(key, F.greatest(F.lit(-1.0), "best").alias("best"))


def assign(rows: DataFrame, centroids: DataFrame, gate: float, key: str = "candidate_id") -> DataFrame:
    """key, centroid, sim: the nearest centroid, the least on ties, where it is near enough."""
    near = blockwise(rows, centroids, key, "centroid", _best, f"{key} long, sim double, centroid long")
    near = near.groupBy(key).agg(F.max(F.struct("sim", (-F.col("centroid")).alias("c"))).alias("x"))
    return near.select(key, (-F.col("x.c")).alias("centroid"), F.col("x.sim").alias("sim")).filter(F.col("sim") >= gate)


def negative_exemplars(rows: DataFrame, kept: DataFrame, rejected: DataFrame) -> DataFrame:
    """The rows that aren't nearer to a rejected story than to every kept page; where nothing is kept there is nothing to compare with, and all stay."""
    if kept.isEmpty():
        return rows
    up = best_similarity(rows, kept).withColumnRenamed("best", "up")
    down = best_similarity(rows, rejected).withColumnRenamed("best", "down")
    near = up.join(down, "candidate_id").filter("down > up").select("candidate_id")
    return rows.join(near, "candidate_id", "left_anti")


def taste(rows: DataFrame, liked: DataFrame, disliked: DataFrame) -> DataFrame:
    """candidate_id, taste: the nearest liked story less the nearest disliked one, of which none counts as 0; null where nothing is liked."""
    if liked.isEmpty():
        return rows.select("candidate_id", F.lit(None).cast("double").alias("taste"))
    up = best_similarity(rows, liked).withColumnRenamed("best", "up")
    if disliked.isEmpty():
        return up.select("candidate_id", F.col("up").alias("taste"))
    return up.join(best_similarity(rows, disliked), "candidate_id").select("candidate_id", (F.col("up") - F.col("best")).alias("taste"))


def neighbour_pairs(rows: DataFrame, floor: float, neighbours: int = 3, key: str = "candidate_id") -> DataFrame:
    """a, b, sim: each row's nearest others above the floor, every pair once.

    Exact, so the work grows with the square of the rows, as matrix products: it is for the stories of a cycle."""
    others = rows.select(F.col(key).alias("other"), F.col("vector").alias("their_vector"))
    top = W.partitionBy(key).orderBy(F.desc("sim"), "other")
    near = blockwise(rows, others, key, "other", _nearest(neighbours, floor), f"{key} long, other long, sim double")
    near = near.withColumn("n", F.row_number().over(top)).filter(F.col("n") <= neighbours)
    return near.select(F.least(key, "other").alias("a"), F.greatest(key, "other").alias("b"), "sim").dropDuplicates(["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node that edges a, b reach. Labels spread to neighbours and then take their label's
    label, until none moves; every round is written, so no plan grows. Nodes and edges are never broadcast, as they would go through the driver each round."""
    edges = edges.select("a", "b").checkpoint()
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node"))
    while True:
        near = both.join(labels.hint("merge"), F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        spread = labels.join(near.hint("merge"), F.col("node") == F.col("a")).select("node", F.least("root", "near").alias("next"), F.col("root").alias("was"))
        up = spread.select(F.col("node").alias("at"), F.col("next").alias("up"))
        moved = spread.join(up.hint("merge"), F.col("next") == F.col("at")).select("node", F.col("up").alias("root"), "was").checkpoint()
        labels = moved.select("node", "root")
        if moved.filter("root <> was").isEmpty():
            return labels


def diversity(rows: DataFrame, group: str, key: str = "candidate_id") -> DataFrame:
    """group, n, diversity: 1 less the mean similarity of a group's pairs, by the sum of its vectors; 0 below two rows.

    The sum over all pairs of dot products is the square of the summed vector less
    the squares of the vectors, so no pair is ever made."""
    parts = rows.select(group, key, F.posexplode("vector").alias("i", "x"))
    sums = parts.groupBy(group, "i").agg(F.sum(F.col("x").cast("double")).alias("s"), F.sum(F.pow(F.col("x").cast("double"), 2)).alias("q"))
    squares = sums.groupBy(group).agg(F.sum(F.pow("s", 2)).alias("all"), F.sum("q").alias("own"))
    counted = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    mean = (F.col("all") - F.col("own")) / (F.col("n") * (F.col("n") - 1))
    return counted.join(squares, group).select(group, "n", F.when(F.col("n") < 2, 0.0).otherwise(1 - mean).alias("diversity"))
