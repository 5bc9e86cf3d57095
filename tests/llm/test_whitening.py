import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.llm.whitening import fit_list, fit_whitening, leading_pairs, minres, whiten, whole_vectors


def random_rows(n=400, d=12, seed=3):
    r = np.random.default_rng(seed)
    v = r.standard_normal((n, d)) * np.linspace(3, 0.5, d)
    rows = [(i, [float(np.float32(c)) for c in x]) for i, x in enumerate(v)]
    return rows + [(i + n, rows[i % 5][1]) for i in range(200)]


def brute(rows, components=4):
    kept = [(i, np.floor(np.array(v) * 256).astype(np.int64)) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.unique(np.array([v for _, v in kept]), axis=0)
    n, sums = len(x), x.sum(0)
    y = x - sums / n
    cov = y.T @ y / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    dev = {}
    for i, v in kept:
        dev.setdefault(i, []).append(sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, sums, strict=True)))
    return n, e, np.trace(cov), {i: (v - sums / n) @ u / np.sqrt(e) for i, v in kept}, dev


def table(spark, rows, kind="array<float>"):
    return spark.createDataFrame(rows, f"vec_id long, embedding {kind}").withColumns({"x": F.lit("clash"), "n": F.lit(-1), "id": F.lit(0)}).repartition(3)


def test_equals_brute_force(spark):
    rows = [*random_rows(), (900, None), (901, [1.0, None] + [0.0] * 10), (902, [float("nan")] * 12), (903, [float("inf")] + [0.0] * 11), (7, random_rows()[9][1])]
    n, e, trace, white, dev = brute(rows)
    out = whiten(table(spark, rows)).collect()
    assert len(out) == 4 * (len(rows) - 4)
    signs = {}
    for r in out:
        assert r.n == n and r.explained == pytest.approx(e[r.component - 1] / trace, rel=1e-9) and r.identity_error < 1e-9
        assert r.deviation in dev[r.vec_id]
        if r.vec_id != 7:
            want = white[r.vec_id][r.component - 1]
            sign = signs.setdefault(r.component, np.sign(want * r.whitened))
            assert r.whitened == pytest.approx(sign * want, abs=1e-9)


def test_residuals_reach_double_precision(spark):
    fit = fit_whitening(whole_vectors(table(spark, random_rows()), "vec_id", "embedding"))
    assert fit.components.passes > 1
    left = fit.fit.covariance_times(fit.components.vectors) - fit.components.values * fit.components.vectors
    assert np.abs(left).max() < 1e-13 * fit.components.values[0]


def test_solver_on_close_equal_and_zero_eigenvalues():
    r = np.random.default_rng(1)
    for values in ([5, 5, 5, 5, 5, 1, 0, 0], [2.0], np.linspace(1, 1.2, 150), 10.0 ** -np.arange(40), np.r_[np.ones(6), np.zeros(90)]):
        q, _ = np.linalg.qr(r.standard_normal((len(values), len(values))))
        m = (q * values) @ q.T
        found = leading_pairs(lambda u, m=m: m @ u, len(values), 4, sum(values))
        assert found.values == pytest.approx(sorted(values, reverse=True)[:4], abs=1e-12 * max(values))
        assert np.abs(m @ found.vectors - found.values * found.vectors).max() < 1e-12 * max(values)


def test_minres_is_least_over_the_krylov_space():
    r = np.random.default_rng(2)
    a = r.standard_normal((25, 25))
    a, b = a + a.T, r.standard_normal((25, 3))
    x = minres(lambda v: a @ v, b, 8)
    for j in range(3):
        space = [b[:, j]]
        for _ in range(7):
            space.append(a @ space[-1])
        q, _ = np.linalg.qr(np.array(space).T)
        best = b[:, j] - a @ q @ np.linalg.lstsq(a @ q, b[:, j], rcond=None)[0]
        assert np.linalg.norm(b[:, j] - a @ x[:, j]) == pytest.approx(np.linalg.norm(best), rel=1e-8)


def test_few_distinct_vectors_and_empty_tables(spark):
    assert whiten(table(spark, [])).collect() == []
    assert whiten(table(spark, [(1, None), (2, [])])).collect() == []
    assert whiten(table(spark, [(i, [1.0, 2.0]) for i in range(9)])).collect() == []
    out = whiten(table(spark, [(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [1.0, 1.0])])).collect()
    assert {(r.vec_id, r.component, r.n, r.deviation, round(abs(r.whitened), 9), round(r.explained, 9)) for r in out} == {(i, 1, 2, 2 * 256**2, 1.0, 1.0) for i in (1, 2, 3)}
    assert len(whiten(table(spark, [(1, [0.0]), (2, [1.0, 2.0]), (None, [0.0, 0.0, 0.0])])).collect()) == 3


def test_large_entries(spark):
    rows = [(1, [3.0e5, 0.0]), (2, [-1.0e7, 1.0]), (3, [2.0e9, 1.0]), (4, [1.0e30, 0.0])]
    out = {r.vec_id: r for r in whiten(table(spark, rows)).collect()}
    assert len(out) == 4 and out[4].deviation is None
    fit = fit_list(whole_vectors(table(spark, rows), "vec_id", "embedding"))
    assert fit.n == 4 and fit.sums[1] == 512 and fit.sums[0] > 2**62
    small = rows[:2]
    got = {r.vec_id: r.deviation for r in whiten(table(spark, small)).collect()}
    x = [[int(np.floor(np.float32(c) * 256.0)) for c in v] for _, v in small]
    sums = [x[0][0] + x[1][0], x[0][1] + x[1][1]]
    want = [sum((2 * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x]
    assert got == {1: want[0] if want[0] < 2**63 else None, 2: want[1] if want[1] < 2**63 else None}
