"""Embedding whitening by Jacobi-Davidson.

Entries become whole numbers first, and equal vectors count once; these distinct
vectors are packed to blocks of one table, the fit list. Its covariance is never
formed: every product with it is a pass over the blocks, in which tasks centre their
vectors, multiply, and add up what Spark then adds over tasks. The driver holds
matrices of the dimension times a few dozen columns alone.

The search space starts from fixed pseudorandom columns. Each round takes the leading
Ritz pairs of the space (Rayleigh-Ritz), locks those whose residuals have reached
double precision, and for the others solves the correction equation, projected beside
locked and current vectors, by some steps of MINRES. All pairs take their steps
together, so that a step is one pass. Corrections widen the space, which restarts
from its leading Ritz vectors where it gets too wide.

Defined results: rows whose vector is null or holds null or non-finite entries are
left out; rows and ids may repeat, ids may be null and of any type; a vector shorter
than the longest one counts as ending in zeros; products beyond the range of long
are cut to it. Components whose eigenvalue is zero but for rounding don't exist, so
equal vectors, one vector or an empty table give no rows. A deviation too large for
long is null. Other columns are never read, so their names can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import materialize

#: Vectors of a block of the fit list.
BLOCK_ROWS = 4096
#: MINRES steps of a round; Ritz pairs beyond the wanted ones that are corrected as well; the widest search space.
INNER, GUARDS, WIDEST = 8, 2, 40
#: A residual of so many units in the last place of the largest eigenvalue counts as double precision.
UNITS = 64
_EPS = np.finfo(float).eps


def whole_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, x: the rows that remain, with floor(256 c) of each entry."""
    kept = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.col("v").isNotNull())
    broken = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(math.inf)))
    return kept.filter(~broken).select("id", F.transform("v", lambda c: F.floor(c * 256)).alias("x"))


def _matrix(x: pa.Array, width: int) -> np.ndarray:
    """The vectors of a batch as rows, ended with zeros."""
    sizes = np.diff(x.offsets.to_numpy())
    values = x.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def _packed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                x = _matrix(batch.slice(at, BLOCK_ROWS).column(0), width)
                kind = next((k for k in (np.int16, np.int32) if _most(x) <= np.iinfo(k).max), np.int64)
                yield pa.RecordBatch.from_pydict(
                    {"kind": [np.dtype(kind).str], "data": [x.astype(kind).tobytes()]}, pa.schema([("kind", pa.string()), ("data", pa.binary())])
                )

    return run


def _most(x: np.ndarray) -> int:
    """The largest absolute entry."""
    return max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0


def _blocks(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    for kind, data in zip(batch.column(0), batch.column(1), strict=True):
        yield np.frombuffer(data.as_py(), kind.as_py()).reshape(-1, width)


@dataclass
class FitList:
    """The distinct vectors, packed: blocks has kind, data; n vectors with the sums of their dimensions."""

    blocks: DataFrame
    width: int
    n: int
    sums: list[int]

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def total(self, of_block: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum over all blocks of an array made of the centred rows of each: added up within tasks, then by place over tasks."""
        width, mean = self.width, self.mean

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = None
            for batch in batches:
                for x in _blocks(batch, width):
                    made = of_block(x - mean).ravel()
                    own = made if own is None else own + made
            if own is not None:
                yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(len(own)), pa.int32()), "v": own})

        rows = self.blocks.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        return np.array([v for _, v in sorted((r.i, r.v) for r in rows)])

    def covariance_times(self, u: np.ndarray) -> np.ndarray:
        """V u for a few columns u, from one pass."""
        return self.total(lambda y: y.T @ (y @ u)).reshape(u.shape) / self.n

    def variances(self) -> np.ndarray:
        return self.total(lambda y: (y * y).sum(0)) / self.n


def fit_list(vectors: DataFrame) -> FitList:
    """The distinct x of whole_vectors()."""
    width = max(1, int(vectors.agg(F.coalesce(F.max(F.size("x")), F.lit(0))).first()[0]))
    # zeros at the end make a shorter vector equal to a longer one
    padded = F.when(F.size("x") == width, F.col("x")).otherwise(F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))))
    distinct = vectors.select(padded.alias("x")).distinct()
    blocks = materialize(distinct.mapInArrow(_packed(width), "kind string, data binary"), "whiten-fit")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, own = 0, [0] * width
        for batch in batches:
            for x in _blocks(batch, width):
                n += len(x)
                exact = x.astype(object if _most(x) * len(x) >= 1 << 62 else np.int64)
                own = [a + int(b) for a, b in zip(own, exact.sum(0), strict=True)]
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(-1, width), pa.int32()), "v": [str(v) for v in [n, *own]]})

    rows = blocks.mapInArrow(sums, "i int, v string").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    found = {r.i: int(r.v) for r in rows}
    return FitList(blocks, width, found.get(-1, 0), [found.get(i, 0) for i in range(width)])


def _orthonormal(space: np.ndarray, new: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what `new` adds to the orthonormal columns of `space`."""
    out = np.zeros((len(new), 0))
    for column in new.T:
        size = np.linalg.norm(column)
        for _ in range(3):
            for q in (space, out):
                column = column - q @ (q.T @ column)
        if (left := np.linalg.norm(column)) > 1e-10 * size and left > 0 and space.shape[1] + out.shape[1] < len(new):
            out = np.column_stack([out, column / left])
    return out


def minres(product: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions of product(x) = right for several columns, each with its own residual least over its Krylov space."""
    norm = lambda x: np.sqrt((x * x).sum(0))
    safe = lambda x: np.where(x > 0, x, 1.0)
    beta = norm(right)
    eta, v, before = beta.copy(), right / safe(beta), np.zeros_like(right)
    w, w_before, x = np.zeros_like(right), np.zeros_like(right), np.zeros_like(right)
    c, c_before, s, s_before = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    first, last = beta.copy(), np.zeros_like(beta)
    for _ in range(steps):
        if (np.abs(eta) <= 1e-4 * safe(first)).all():
            break
        p = product(v)
        alpha = (v * p).sum(0)
        p = p - alpha * v - last * before
        following = norm(p)
        # the rotations of the steps before, then the one that clears the new entry below the diagonal
        r3, r2 = s_before * last, c_before * c * last + s * alpha
        r1 = c * alpha - c_before * s * last
        r0 = np.hypot(r1, following)
        live = r0 > 1e-300
        c_before, s_before = c, s
        c, s = np.where(live, r1 / np.where(live, r0, 1.0), 1.0), np.where(live, following / np.where(live, r0, 1.0), 0.0)
        w, w_before = np.where(live, (v - r3 * w_before - r2 * w) / np.where(live, r0, 1.0), 0.0), w
        x = x + c * eta * w
        eta = -s * eta
        before, v, last = v, p / safe(following), following
    return x


@dataclass
class Components:
    """values: eigenvalues, falling; vectors: a column each; rounds and passes that it took."""

    values: np.ndarray
    vectors: np.ndarray
    rounds: int
    passes: int


def leading_pairs(times: Callable[[np.ndarray], np.ndarray], width: int, wanted: int, scale: float, most_rounds: int = 100) -> Components:
    """The leading eigenpairs of a symmetric positive semidefinite matrix that is known by its products alone; scale: its trace."""
    passes = 0

    def product(u: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return times(u)

    wanted = min(wanted, width)
    block = min(wanted + GUARDS, width)
    random = np.random.default_rng(12)
    space = _orthonormal(np.zeros((width, 0)), random.standard_normal((width, block)))
    image = product(space)
    locked, locked_image = np.zeros((width, 0)), np.zeros((width, 0))
    history: list[float] = []
    for rounds in range(1, most_rounds + 1):
        values, turns = np.linalg.eigh((space.T @ image + image.T @ space) / 2)
        order = np.argsort(-values)
        values, ritz = values[order], space @ turns[:, order]
        ritz_image = image @ turns[:, order]
        open_pairs = min(wanted - locked.shape[1], len(values))
        residual = ritz_image - values * ritz
        size = np.sqrt((residual * residual).sum(0))
        top = max([*values[:1], *np.einsum("ij,ij->j", locked, locked_image)], default=0.0)
        limit = UNITS * _EPS * max(top, _EPS * scale)
        history.append(float(size[:open_pairs].max(initial=0.0)))
        # rounding can hold a residual a little above the limit: it has then stopped falling
        stuck = len(history) > 3 and min(history[-2:]) > 0.5 * history[-3] and history[-1] <= 1e4 * limit
        done = (size[:open_pairs] <= limit) | stuck
        if done.any():
            locked, locked_image = np.column_stack([locked, ritz[:, :open_pairs][:, done]]), np.column_stack([locked_image, ritz_image[:, :open_pairs][:, done]])
            left = np.r_[np.flatnonzero(~done), open_pairs : len(values)].astype(int)
            space, image, values, residual = ritz[:, left], ritz_image[:, left], values[left], residual[:, left]
            history.clear()
            ritz, ritz_image, open_pairs = space, image, open_pairs - int(done.sum())
        if not open_pairs or not len(values):
            break
        targets = min(open_pairs + GUARDS, len(values))
        shifts, current = values[:targets], ritz[:, :targets]
        beside = np.column_stack([locked, current])

        def projected(u: np.ndarray, beside=beside, shifts=shifts) -> np.ndarray:
            u = u - beside @ (beside.T @ u)
            y = product(u) - shifts * u
            return y - beside @ (beside.T @ y)

        corrections = minres(projected, -residual[:, :targets], INNER)
        if space.shape[1] + targets > WIDEST:
            keep = max(2 * block, WIDEST // 2)
            space, image = ritz[:, :keep], ritz_image[:, :keep]
        new = _orthonormal(np.column_stack([locked, space]), corrections)
        if not new.shape[1]:
            new = _orthonormal(np.column_stack([locked, space]), random.standard_normal((width, targets)))
        if new.shape[1]:
            space, image = np.column_stack([space, new]), np.column_stack([image, product(new)])
    else:
        raise RuntimeError(f"residuals did not reach double precision in {most_rounds} rounds")
    values, turns = np.linalg.eigh((locked.T @ locked_image + locked_image.T @ locked) / 2)
    order = np.argsort(-values)
    return Components(values[order], locked @ turns[:, order], rounds, passes)


@dataclass
class Whitening:
    fit: FitList
    components: Components
    trace: float
    identity_error: float

    def transform(self, vectors: DataFrame, id_name: str = "vec_id") -> DataFrame:
        """A row for each of the vectors of whole_vectors() and each component."""
        id_type = vectors.schema["id"].dataType
        fit, found = self.fit, self.components
        n, width, count = fit.n, fit.width, len(found.values)
        rest = "component int, n long, deviation long, whitened double, explained double, identity_error double"
        schema = StructType([StructField(id_name, id_type), *StructType.fromDDL(rest).fields])
        if not count:
            return vectors.sparkSession.createDataFrame([], schema)
        mean, turn = fit.mean, found.vectors / np.sqrt(found.values)
        explained, error = found.values / self.trace, self.identity_error
        wrapped = np.array([s % (1 << 64) for s in fit.sums], np.uint64)
        sums = fit.sums

        def deviations(x: np.ndarray) -> pa.Array:
            # modulo 2^64 the sum is exact; where it is too large for long, an estimate in doubles says so
            diff = np.uint64(n % (1 << 64)) * x.astype(np.int64).view(np.uint64) - wrapped
            exact = (diff * diff).sum(1, dtype=np.uint64).view(np.int64)
            near = ((float(n) * (x - mean)) ** 2).sum(1)
            large = near >= 2.0**63
            for i in np.flatnonzero(np.abs(near / 2.0**63 - 1) < 1e-6):
                large[i] = sum((n * int(a) - s) ** 2 for a, s in zip(x[i], sums, strict=True)) >= 1 << 63
            return pa.array(exact, mask=large)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column(1), width)
                rows = pa.array(np.repeat(np.arange(len(x)), count))
                z = (x - mean) @ turn
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(rows),
                        pa.array(np.tile(np.arange(1, count + 1), len(x)), pa.int32()),
                        pa.array(np.full(len(rows), n), pa.int64()),
                        deviations(x).take(rows),
                        pa.array(z.ravel()),
                        pa.array(np.tile(explained, len(x))),
                        pa.array(np.full(len(rows), error)),
                    ],
                    names=[id_name, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

        return vectors.mapInArrow(run, schema)


def fit_whitening(vectors: DataFrame, components: int = 4) -> Whitening:
    """Fit on the distinct vectors of whole_vectors()."""
    fit = fit_list(vectors)
    trace = float(fit.variances().sum()) if fit.n and fit.width else 0.0
    if trace <= 0.0:
        return Whitening(fit, Components(np.zeros(0), np.zeros((fit.width, 0)), 0, 0), trace, 0.0)
    found = leading_pairs(fit.covariance_times, fit.width, components, trace)
    real = found.values > fit.width * 4 * _EPS * trace
    found = Components(found.values[real], found.vectors[:, real], found.rounds, found.passes)
    turn = found.vectors / np.sqrt(found.values)
    k = len(found.values)
    sums = fit.total(lambda y: np.concatenate([((z := y @ turn).T @ z).ravel(), z.sum(0)])) / fit.n
    covariance = sums[: k * k].reshape(k, k) - np.outer(sums[k * k :], sums[k * k :])
    return Whitening(fit, found, trace, float(np.abs(covariance - np.eye(k)).max()))


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4) -> DataFrame:
    """id_col, component, n, deviation, whitened, explained, identity_error; see the module."""
    vectors = whole_vectors(df, id_col, vector_col)
    return fit_whitening(vectors, components).transform(vectors, id_col)
