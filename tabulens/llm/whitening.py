"""Whitening of vectors along their principal components, found by a Jacobi-Davidson iteration.

Entries become integers, x = floor(SCALE * c) + SHIFT. The components are the eigenvectors of the
covariance of all x-vectors with the largest eigenvalues; ``whiten`` projects each centred vector on
them and divides by the root of the eigenvalue.

The covariance is never formed. All that the iteration asks for is its product with a few vectors at
once, one pass of Spark over the integer vectors: a task centres its rows, multiplies them with
the vectors and back, and what the tasks return is summed by Spark, one number for each entry. The
driver holds a search space of a few vectors as long as one row.

One outer step (``jacobi_davidson``): Rayleigh-Ritz in the search space; the leading pairs whose
residual has reached ``RESIDUAL`` of the largest eigenvalue are locked, in order; for the others
the correction equation (A - theta) t = -r, projected beside the locked and the wanted vectors, is
solved roughly by MINRES, all of them together, so that an inner step is one pass; the corrections
extend the space, which restarts from its best vectors when full. It ends when all wanted pairs are
locked or the space is the whole space, where Rayleigh-Ritz is exact.

Centring is exact: with m = S div n and r = S mod n, x - S/n is the integer x - m less r/n.

What is shuffled: sums. The vectors are written once to the checkpoint folder, as integers. A task
holds one batch of rows and as many vectors as components.

Defined cases: rows whose vector is null, or holds nulls, non-finite entries or integers beyond
2**53, are dropped, as are those that have another length than most (of lengths equally common the
larger; empty vectors count as none). Repeated rows and ids are rows of their own, null ids stay.
Components whose eigenvalue is below ``RANK`` of the largest do not count (a constant direction
cannot be whitened), so constant vectors and a single one give no rows; fewer dimensions than
components give fewer components; of equal eigenvalues any orthogonal vectors are taken. A
deviation beyond a long is null. Extra columns do not matter; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.session import pin

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
# residual of a locked pair and least eigenvalue, as shares of the largest eigenvalue
RESIDUAL, RANK = 2e-15, 1e-9
# MINRES steps of a correction, and search vectors for each component
INNER, SPACE = 8, 6
OUTER = 100
LARGEST = 2**53
LOW_BITS = 26

Product = Callable[[np.ndarray], np.ndarray]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The packed vectors of a batch as rows of integers."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset :][: len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.int64, len(column) * dim, offsets[0]).reshape(
        -1, dim
    )


def _pack(batches: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """(id, dim, x) of the usable rows; x holds the integers of a vector."""
    for batch in batches:
        ids, dims, packed = [], [], []
        for i, vector in enumerate(batch.column("v")):
            values = vector.values
            if values is None or not len(values) or values.null_count:
                continue
            scaled = np.floor(values.to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
            if not (np.abs(scaled) <= LARGEST - SHIFT).all():  # false for NaN too
                continue
            ids.append(i)
            dims.append(len(scaled))
            packed.append((scaled.astype(np.int64) + SHIFT).tobytes())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id").take(pa.array(ids, pa.int64())).cast(id_type),
                pa.array(dims, pa.int32()),
                pa.array(packed, pa.binary()),
            ],
            names=["id", "dim", "x"],
        )


@dataclass
class Points:
    """The integer vectors (id, x) of a table, their number, and S = n * whole + rest."""

    frame: DataFrame
    n: int
    dim: int
    whole: np.ndarray
    rest: np.ndarray

    def sums(self, of: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        """Sum over all rows of ``of(centred rows)``, an array of ``shape``; one pass."""
        size = int(np.prod(shape))
        # plain values, so that the function does not carry the frame
        dim, whole, fraction = self.dim, self.whole, self.rest / self.n

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for batch in batches:
                if len(batch):
                    total += of(_matrix(batch.column("x"), dim) - whole - fraction)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(size, dtype=np.int32)), pa.array(total.ravel())],
                names=["i", "v"],
            )

        rows = self.frame.select("x").mapInArrow(partial, "i int, v double")
        summed = rows.groupBy("i").agg(F.sum("v").alias("v")).toArrow()
        out = np.zeros(size)
        out[summed["i"].to_numpy()] = summed["v"].to_numpy()
        return out.reshape(shape)


def points(df: DataFrame, id_col: str, vector_col: str) -> Points | None:
    """The vectors of a table as integers; None if no row is usable."""
    rows = df.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{vector_col}`").cast("array<double>").alias("v"),
    ).where("v IS NOT NULL")
    kind = rows.schema["id"].dataType.simpleString()
    id_type = rows.select("id").limit(0).toArrow().schema.field("id").type
    packed = pin(rows.mapInArrow(lambda b: _pack(b, id_type), f"id {kind}, dim int, x binary"))
    dims = packed.groupBy("dim").agg(F.count("*").alias("n"))
    top = dims.orderBy(F.desc("n"), F.desc("dim")).first()
    if top is None:
        return None
    n, dim = top.n, top.dim
    frame = packed.where(F.col("dim") == dim).select("id", "x")

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of the high and low bits of every dimension: no sum leaves a long."""
        total = np.zeros((2, dim), np.int64)
        for batch in batches:
            if len(batch):
                x = _matrix(batch.column("x"), dim)
                total[0] += (x >> LOW_BITS).sum(axis=0)
                total[1] += (x & ((1 << LOW_BITS) - 1)).sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(2 * dim, dtype=np.int32)), pa.array(total.ravel())],
            names=["i", "v"],
        )

    summed = (
        frame.select("x")
        .mapInArrow(halves, "i int, v long")
        .groupBy("i")
        .agg(F.sum("v").alias("v"))
        .toArrow()
    )
    by_place = dict(zip(summed["i"].to_pylist(), summed["v"].to_pylist(), strict=True))
    sums = [(by_place[i] << LOW_BITS) + by_place[dim + i] for i in range(dim)]
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], np.int64)
    return Points(frame, n, dim, whole, rest)


def _orthonormal(vectors: np.ndarray, beside: np.ndarray) -> np.ndarray:
    """A basis of what ``vectors`` add to the orthonormal columns of ``beside``."""
    out = beside[:, :0]
    for v in vectors.T:
        size = np.linalg.norm(v)
        if not size:
            continue
        v = v / size
        for _ in range(3):
            v = v - beside @ (beside.T @ v)
            v = v - out @ (out.T @ v)
            left = np.linalg.norm(v)
            if left < 1e-10:
                break
            v = v / left
        else:
            out = np.column_stack([out, v])
    return out


def minres(
    product: Product, shifts: np.ndarray, right: np.ndarray, beside: np.ndarray, steps: int
) -> np.ndarray:
    """Rough solutions of P (A - shift) P t = right, one for each column, P projecting beside.

    All systems take their steps together, so that each step is one product. A system stops for
    itself when its Krylov space is exhausted.
    """

    def project(v: np.ndarray) -> np.ndarray:
        v = v - beside @ (beside.T @ v)
        return v - beside @ (beside.T @ v)

    many = right.shape[1]
    x = np.zeros_like(right)
    v = project(right)
    beta = np.linalg.norm(v, axis=0)
    scale = np.where(beta > 0, beta, 1.0)
    alive = beta > 0
    v = v / scale
    v_before = np.zeros_like(v)
    d1 = np.zeros_like(v)  # directions of the last two steps
    d2 = np.zeros_like(v)
    eta = beta.copy()
    c1, c2 = np.ones(many), np.ones(many)
    s1, s2 = np.zeros(many), np.zeros(many)
    before = np.zeros(many)
    for _ in range(steps):
        if not alive.any():
            break
        w = project(product(v) - shifts * v)
        alpha = (v * w).sum(axis=0)
        w = project(w - alpha * v - before * v_before)
        after = np.linalg.norm(w, axis=0)
        # rotations of the last two steps applied to the new column, and a new one
        delta = c1 * alpha - c2 * s1 * before
        rho1 = np.hypot(delta, after)
        rho2 = s1 * alpha + c2 * c1 * before
        rho3 = s2 * before
        good = alive & (rho1 > 1e-300)
        safe = np.where(good, rho1, 1.0)
        c2, s2 = c1, s1
        c1, s1 = np.where(good, delta / safe, 1.0), np.where(good, after / safe, 0.0)
        d = (v - rho3 * d2 - rho2 * d1) / safe
        x = x + np.where(good, c1 * eta, 0.0) * d
        eta = -s1 * eta
        d1, d2 = d, d1
        alive = good & (after > 1e-14 * scale) & (after > 1e-14 * np.abs(alpha))
        v_before, v = v, w / np.where(alive, after, 1.0)
        v = np.where(alive, v, 0.0)
        before = np.where(alive, after, 0.0)
    return project(x)


def jacobi_davidson(
    product: Product, dim: int, wanted: int, seed: int = 0
) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and unit eigenvectors of a symmetric matrix.

    The matrix is known by its ``product`` with the columns of an array.
    """
    wanted = min(wanted, dim)
    most = min(dim, SPACE * wanted)
    draw = np.random.default_rng(seed)
    locked, values = np.zeros((dim, 0)), np.zeros(0)
    space = _orthonormal(draw.standard_normal((dim, wanted)), locked)
    image = product(space)
    top, best, still = 0.0, np.inf, 0
    for _ in range(OUTER):
        small = space.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        top = max(top, theta[0], *values) if len(values) else max(top, theta[0])
        need = min(wanted - len(values), space.shape[1])
        ritz, moved = space @ turn, image @ turn
        left = moved[:, :need] - ritz[:, :need] * theta[:need]
        left = left - locked @ (locked.T @ left)
        sizes = np.linalg.norm(left, axis=0)
        whole = space.shape[1] + locked.shape[1] >= dim
        # what rounding leaves cannot shrink on: a space that gains nothing more is as good as it gets
        worst = sizes.max()
        still = still + 1 if worst >= best / 2 and worst <= 1e-12 * top else 0
        best = min(best, worst)
        done = need if whole or still >= 3 else 0
        while done < need and sizes[done] <= RESIDUAL * top * np.sqrt(dim):
            done += 1
        locked = np.column_stack([locked, ritz[:, :done]])
        values = np.append(values, theta[:done])
        if len(values) >= wanted:
            order = np.argsort(-values)
            return values[order], locked[:, order]
        ritz, moved, theta = ritz[:, done:], moved[:, done:], theta[done:]
        left, sizes = left[:, done:], sizes[done:]
        open_ = need - done
        if done:
            best, still = np.inf, 0
        keep = ritz.shape[1] if ritz.shape[1] + open_ <= most else max(2 * open_, open_ + 2)
        space, image = ritz[:, :keep], moved[:, :keep]
        beside = np.column_stack([locked, space[:, :open_]])
        inner = min(INNER, max(dim - beside.shape[1], 0))
        fixed = -left if inner == 0 else minres(product, theta[:open_], -left, beside, inner)
        fresh = _orthonormal(fixed, np.column_stack([locked, space]))
        missing = min(open_, dim - locked.shape[1] - space.shape[1]) - fresh.shape[1]
        if fresh.shape[1] == 0 and missing > 0:
            fresh = _orthonormal(
                draw.standard_normal((dim, missing)), np.column_stack([locked, space])
            )
        if fresh.shape[1]:
            space = np.column_stack([space, fresh])
            image = np.column_stack([image, product(fresh)])
    raise ArithmeticError(f"no convergence in {OUTER} steps, residuals {sizes}")


def covariance_product(data: Points) -> Product:
    """Product of the covariance of the points with the columns of an array, one pass each."""

    def product(vectors: np.ndarray) -> np.ndarray:
        return data.sums(lambda c: c.T @ (c @ vectors), vectors.shape) / data.n

    return product


@dataclass
class Whitening:
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float


def fit(data: Points, components: int = COMPONENTS) -> Whitening:
    """The components of the points, and how far their whitened covariance is from the identity."""
    trace = float(data.sums(lambda c: np.array([(c * c).sum()]), (1,))[0]) / data.n
    if trace <= 0:
        return Whitening(np.zeros(0), np.zeros((data.dim, 0)), 0.0, 0.0)
    values, vectors = jacobi_davidson(covariance_product(data), data.dim, components)
    sound = values > RANK * values[0]
    values, vectors = values[sound], vectors[:, sound]
    scaled = vectors / np.sqrt(values)
    k = len(values)

    def moments(c: np.ndarray) -> np.ndarray:
        w = c @ scaled
        return np.vstack([w.T @ w, w.sum(axis=0)])

    sums = data.sums(moments, (k + 1, k)) / data.n
    error = float(np.abs(sums[:k] - np.outer(sums[k], sums[k]) - np.eye(k)).max())
    return Whitening(values, vectors, trace, error)


def _deviations(x: np.ndarray, whole: np.ndarray, rest: np.ndarray, n: int) -> list[int | None]:
    """Sum over the dimensions of (n * x - S) ** 2, exact; None beyond a long."""
    off = x - whole
    if len(off) and x.shape[1] * (float(np.abs(off).max()) + 1) ** 2 * float(n) ** 2 < 2**62:
        return ((n * off - rest) ** 2).sum(axis=1).tolist()
    exact = ((n * off.astype(object) - rest.astype(object)) ** 2).sum(axis=1)
    return [int(d) if d < 2**63 else None for d in exact]


RESULT = (
    "component int, n long, deviation long, whitened double, explained double, "
    "identity_error double"
)


def whiten(
    df: DataFrame,
    components: int = COMPONENTS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every usable row."""
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, {RESULT}"
    data = points(df, id_col, vector_col)
    own = fit(data, components) if data is not None else None
    if own is None or not len(own.values):
        return df.sparkSession.createDataFrame([], schema)
    n, dim, whole, rest = data.n, data.dim, data.whole, data.rest
    scaled = own.vectors / np.sqrt(own.values)
    k = len(own.values)
    explained, error = own.values / own.trace, own.identity_error

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column("x"), dim)
            white = (x - whole - rest / n) @ scaled
            rows = np.repeat(np.arange(len(x)), k)
            deviation = pa.array(_deviations(x, whole, rest, n), pa.int64())
            many = len(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(rows)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(many, n, np.int64)),
                    deviation.take(pa.array(rows)),
                    pa.array(white.ravel()),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(many, error)),
                ],
                names=[
                    "id", "component", "n", "deviation", "whitened", "explained",
                    "identity_error",
                ],
            )

    return data.frame.mapInArrow(project, schema)
