"""The index of inverted lists: recall against brute force, blocks of hot lists, exact scores."""

import numpy as np
from pyspark.sql import functions as F

from feedloom.operators import index, similarity


def test_recall_over_the_stated_query_set(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("candidate_id"), F.col("embedding").alias("vector"))
    queries = rows.filter("candidate_id % 20 = 0")
    x = np.array([r.vector for r in rows.orderBy("candidate_id").collect()])
    found = index.build(rows).neighbours(queries, 10).collect()
    by: dict[int, dict[int, float]] = {}
    for r in found:
        by.setdefault(r["query"], {})[r.other] = r.sim
    hits = 0
    for q in range(0, len(x), 20):
        sims = x @ x[q]
        sims[q] = -2
        best = np.argsort(-sims)[:10]
        assert len(by[q]) == 10 and all(abs(sims[o] - s) < 1e-5 for o, s in by[q].items())
        hits += len(set(best.tolist()) & set(by[q]))
    assert hits / (10 * len(by)) >= 0.9


def test_clustered_vectors_need_few_lists(spark):
    r = np.random.default_rng(1)
    centres = r.standard_normal((40, 16)) * 5
    x = np.repeat(centres, 50, axis=0) + r.standard_normal((2000, 16)) * 0.3
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "candidate_id long, vector array<double>")
    made = index.build(rows)
    assert made.probes <= 6 < len(made.centroids)


def test_all_lists_are_all_rows(spark, monkeypatch):
    monkeypatch.setattr(index, "BLOCK", 16)  # hot lists in many blocks
    r = np.random.default_rng(0)
    x = np.r_[r.standard_normal((60, 8)), np.tile(r.standard_normal(8), (40, 1))]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "candidate_id long, vector array<double>")
    got = index.build(rows, lists=6).neighbours(rows, 4, floor=0.2, probes=6)
    want = similarity.neighbour_pairs(rows, 0.2, 4)
    pairs = {(min(a, b), max(a, b)) for a, b, _ in got.collect()}
    assert pairs == {(a, b) for a, b, _ in want.collect()}


def test_fresh_stories_meet_earlier_ones(spark):
    v = {1: [1.0, 0.0], 2: [0.99, 0.1], 3: [0.98, 0.15], 4: [0.0, 1.0], 5: [0.05, 1.0]}
    rows = spark.createDataFrame(list(v.items()), "candidate_id long, vector array<double>")
    fresh, earlier = rows.filter("candidate_id IN (1, 4)"), rows.filter("candidate_id NOT IN (1, 4)")
    got = {(r.a, r.b) for r in index.near_pairs(fresh, earlier, probes=9).collect()}
    assert got == {(1, 2), (1, 3), (4, 5)}
    assert index.near_pairs(fresh.limit(0), earlier).collect() == [] and index.near_pairs(fresh.limit(0), earlier.limit(0)).collect() == []
