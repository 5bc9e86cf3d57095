import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.llm.language import remainder
from feedloom.llm.quality import STATISTICS, Discriminant, fit, quality_scores, statistics

R = random.Random(2)


def good(n):
    return " ".join("".join(R.choice("etaoinshr") for _ in range(R.randint(2, 9))) + ("." if R.random() < 0.1 else "") for _ in range(n))


def bad(n):
    return " ".join(R.choice(["BUY!!!", "$$$", "### 99", "CLICK***"]) for _ in range(n))


def tables(spark, n=400):
    rows = [(i, (bad if i % 4 == 0 else good)(R.randint(5, 80)), "x") for i in range(n)]
    rows += [(9000, None, "x"), (9001, "", None), (9002, good(20_000), "x"), (None, good(9), "x"), (3, rows[3][1], "x")]
    marks = [(i, int(i % 4 != 0), None) for i in range(0, n, 2)] + [(1, None, 1), (7, 5, 0), (None, 0, 0), (9001, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, x string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_every_row(spark):
    docs, labels = tables(spark)
    out = quality_scores(docs, labels, remainder("doc_id", 5) != 0).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    held = [r for r in out if r.doc_id is not None and r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.predicted == int(r.doc_id % 4 != 0) for r in held) >= 0.95 * len(held)


def test_scores_equal_the_densities_worked_out_plainly():
    rng = np.random.default_rng(1)
    x = {0: rng.normal(0, 1, (50, 3)), 1: rng.normal(1, 2, (80, 3))}
    sums = {c: np.concatenate([[len(v)], v.sum(0), (v.T @ v).ravel()]) for c, v in x.items()}
    model = Discriminant(sums, size=3, pool=0.0, sphere=0.0)
    point = np.array([[0.3, -0.2, 1.0]])

    def log_density(v):
        mean, spread = v.mean(0), np.cov(v.T, bias=True)
        d = point[0] - mean
        return math.log(len(v) / 130) - 0.5 * (d @ np.linalg.solve(spread, d) + math.log(np.linalg.det(spread)))

    want = 1 / (1 + math.exp(log_density(x[0]) - log_density(x[1])))
    assert model.scores(point)[0] == pytest.approx(want)


def test_sums_equal_those_of_all_labelled_rows(spark):
    docs, labels = tables(spark)
    rows = [r.text for r in docs.join(labels.filter("quality in (0, 1)"), "doc_id").filter("quality = 1").collect()]
    vectors = docs.select("doc_id", "text").repartition(5)
    from feedloom.llm.quality import document_statistics

    model = fit(document_statistics(vectors), labels)
    want = np.array([statistics(t) for t in rows])
    assert len(STATISTICS) == want.shape[1]
    assert np.allclose(model.parts[1][0] * model.scale, want.mean(0))


def test_no_labels_one_class_and_empty(spark):
    docs, labels = tables(spark, 20)
    none = quality_scores(docs, labels.filter("false"), F.lit(True))
    assert {r.score for r in none.collect()} == {0.5}
    assert {r.score for r in quality_scores(docs, labels.filter("quality = 1"), F.lit(True)).collect()} == {1.0}
    assert quality_scores(docs.filter("false"), labels, F.lit(True)).count() == 0
