"""Whitening of embeddings by LOBPCG.

The leading eigenvectors of the covariance come from a locally optimal block conjugate gradient
iteration. The covariance is never formed: each step multiplies it with a block of
directions, as a sum over blocks of centred rows of rows' * (rows * directions), on the
executors. Rayleigh-Ritz on the iterate, the residuals and the previous directions gives the next
iterate. The iteration ends when the residuals, under a product made afresh, are below
TOLERANCE times the largest eigenvalue: a residual divided by the gap to the other
eigenvalues bounds a vector's error.

The driver holds blocks of dimensions x (components + GUARD) numbers; a task holds one block of
rows and sums up its own products, so what it sends has the size of the block of directions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, table
from .topk import scaled, usable

SCALE = 256
COMPONENTS = 4
GUARD = 12  # directions beyond the components: the block converges by the gap behind them
TOLERANCE = 1e-13
MOST_STEPS = 1000
RANK = 1e-12  # an eigenvalue below this share of the trace counts as zero
BLOCK = 8192


@dataclass
class Whitening:
    """n fit vectors and their sums by dimension; unit eigenvectors as columns, eigenvalues
    falling; trace of the covariance; residual norms; error of the whitened covariance."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    residuals: np.ndarray
    steps: int
    identity_error: float


def _wide(n: int, x: np.ndarray, sums: list[int], power: int = 1) -> bool:
    """Whether n * x - sums, squared and summed for power 2, could leave 64 bits."""
    most = n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, sums)) if x.size else 0
    return most**power * (len(sums) if power > 1 else 1) >= 1 << 63


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x less the mean, rounded once: the difference times n is a whole number."""
    if _wide(n, x, sums):
        return ((n * x.astype(object) - np.array(sums, object)) / n).astype(np.float64)
    return (n * x - np.array(sums, np.int64)) / n


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over dimensions of (n * x - sums) ** 2 for each row, exactly."""
    wide = _wide(n, x, sums, 2)
    d = n * x.astype(object if wide else np.int64) - np.array(sums, object if wide else np.int64)
    return [int(v) for v in (d * d).sum(axis=1)]


def _stacked(vectors: pd.Series, dims: int) -> np.ndarray:
    return np.stack(list(vectors)).astype(np.int64, copy=False) if len(vectors) else np.zeros((0, dims), np.int64)


def _blocks(distinct: DataFrame, dims: int) -> DataFrame:
    """v: vectors of dims whole numbers. Rows of up to BLOCK vectors each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        for b in batches:
            held.append(_stacked(b["v"], dims))
            if sum(map(len, held)) >= BLOCK:
                yield pd.DataFrame({"x": [np.concatenate(held).tobytes()]})
                held = []
        if held:
            yield pd.DataFrame({"x": [np.concatenate(held).tobytes()]})

    return distinct.mapInPandas(run, "x binary")


def _summed(blocks: DataFrame, dims: int, shape: tuple[int, int], part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of what part makes of a block's vectors, of the given shape."""
    names = [f"p{j}" for j in range(shape[1])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(shape)
        for b in batches:
            for raw in b["x"]:
                total += part(np.frombuffer(raw, np.int64).reshape(-1, dims))
        yield pd.DataFrame(total, columns=names).assign(i=np.arange(shape[0], dtype=np.int32))[["i", *names]]

    rows = blocks.mapInPandas(run, "i int, " + ", ".join(f"{c} double" for c in names)).groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).collect()
    out = np.zeros(shape)
    for r in rows:
        out[r["i"]] = r[1:]
    return out


def _moments(blocks: DataFrame, dims: int) -> tuple[int, list[int], list[int]]:
    """Vectors, sums and sums of squares by dimension, exactly."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, q = 0, np.zeros(dims, object), np.zeros(dims, object)
        for b in batches:
            for raw in b["x"]:
                x = np.frombuffer(raw, np.int64).reshape(-1, dims)
                if max(abs(int(x.min())), abs(int(x.max()))) ** 2 * len(x) >= 1 << 63:
                    x = x.astype(object)
                n, s, q = n + len(x), s + x.sum(axis=0).astype(object), q + (x * x).sum(axis=0).astype(object)
        yield pd.DataFrame({"i": np.arange(dims, dtype=np.int32), "n": n, "s": [Decimal(int(v)) for v in s], "q": [Decimal(int(v)) for v in q]})

    kinds = "i int, n long, s decimal(38,0), q decimal(38,0)"
    rows = {r["i"]: r for r in blocks.mapInPandas(run, kinds).groupBy("i").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")]).collect()}
    return rows[0]["n"], [int(rows[i]["s"]) for i in range(dims)], [int(rows[i]["q"]) for i in range(dims)]


def _ordered(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, vectors = np.linalg.eigh((h + h.T) / 2)
    return values[::-1], vectors[:, ::-1]


def _basis(w: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what w adds to the orthonormal columns of against."""
    for _ in range(3):
        if not w.shape[1]:
            break
        w = w - against @ (against.T @ w)
        u, s, _ = np.linalg.svd(w, full_matrices=False)
        w = u[:, s > 1e-8]
    return w


def lobpcg(product: Callable[[np.ndarray], np.ndarray], dims: int, k: int, guard: int = GUARD, tolerance: float = TOLERANCE, most: int = MOST_STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Eigenvalues (falling), unit eigenvectors and certified residual norms of the k leading
    pairs of a symmetric positive semidefinite operator, and the steps taken."""
    k, m = min(k, dims), min(dims, k + guard)
    x = np.linalg.qr(np.random.default_rng(12).standard_normal((dims, m)))[0]
    ax, p = product(x), np.zeros((dims, 0))
    fresh, least, stalled = True, np.inf, 0
    for step in range(1, most + 1):
        values, c = _ordered(x.T @ ax)
        x, ax = x @ c, ax @ c
        r = ax - x * values
        norms = np.linalg.norm(r, axis=0)
        scale = max(values[0], np.finfo(float).tiny)
        worst = norms[:k].max() / scale if values[0] > 0 else 0.0
        # Rounding sets a floor that no further step lowers; what it is, is returned.
        stalled = stalled + 1 if worst > least / 2 else 0
        least = min(least, worst)
        if worst <= tolerance or stalled >= 5 and worst <= 100 * tolerance:
            if fresh:
                return values[:k], x[:, :k], norms[:k], step
            x = np.linalg.qr(x)[0]
            ax, fresh = product(x), True
            continue
        live = norms > 1e-2 * tolerance * scale
        w = _basis(r[:, live] / norms[live], x)
        p = _basis(p, np.hstack([x, w]))
        s = np.hstack([x, w, p])
        as_ = product(s)
        y = _ordered(s.T @ as_)[1][:, :m]
        p = s[:, m:] @ y[m:]
        p = p / np.maximum(np.linalg.norm(p, axis=0), np.finfo(float).tiny)
        x, tri = np.linalg.qr(s @ y)
        ax, fresh = np.linalg.solve(tri.T, (as_ @ y).T).T, False
    raise ArithmeticError(f"residual {worst:.3g} of the largest eigenvalue after {most} steps")


def rows_of(vectors: DataFrame, id_col: str, vec_col: str, scale: float = SCALE) -> tuple[DataFrame, int]:
    """id and v, the components times scale, rounded down, for every usable row, as a table; and the
    greatest number of components, to which shorter vectors are filled up with zeros."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("raw")).where(usable(F.col("raw")))
    rows = table(rows.select("id", scaled(F.col("raw"), scale).alias("v")))
    dims = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    filled = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("v")))
    out = rows.withColumn("v", filled)
    out._stored = rows._stored
    return out, dims


def fit(rows: DataFrame, dims: int, k: int = COMPONENTS) -> Whitening | None:
    """rows: v, vectors of dims whole numbers; each distinct vector counts once. None if there is no
    vector or none has a component."""
    if not dims:
        return None
    blocks = table(_blocks(rows.select("v").distinct(), dims))
    if not blocks.limit(1).count():
        return None
    n, sums, squares = _moments(blocks, dims)
    trace = sum(n * q - s * s for s, q in zip(sums, squares, strict=True)) / n**2

    def product(b: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = centred(x, n, sums)
            return c.T @ (c @ b)

        return _summed(blocks, dims, b.shape, part) / n

    values, vectors, residuals, steps = lobpcg(product, dims, k)
    use = values > RANK * trace
    values, vectors, residuals = values[use], vectors[:, use], residuals[use]
    w, error = vectors / np.sqrt(values), 0.0
    if len(values):
        mean = _summed(blocks, dims, (1, len(values)), lambda x: (centred(x, n, sums) @ w).sum(axis=0)[None]) / n

        def spread(x: np.ndarray) -> np.ndarray:
            z = centred(x, n, sums) @ w - mean
            return z.T @ z

        error = float(np.abs(_summed(blocks, dims, (len(values), len(values)), spread) / n - np.eye(len(values))).max())
    release(blocks)
    return Whitening(n, sums, vectors, values, trace, residuals, steps, error)


def whitened(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = COMPONENTS, *, scale: float = SCALE) -> tuple[DataFrame, Whitening | None]:
    """id, deviation (decimal: sum over dimensions of (n * x - sums) ** 2) and whitened (an array
    by component) for every usable row, and the fitted model.

    Rows whose vector is null or holds null or non-finite entries take no part. A shorter vector
    counts as filled up with zeros. Repeated vectors count once in the fit, and every row has a
    result; null ids stay. Components whose eigenvalue is zero (fewer distinct vectors than
    components, or constant ones) are left out, so one vector alone has an empty array. An
    empty table, or vectors without components, give empty results and no model. Other columns are not read."""
    rows, dims = rows_of(vectors, id_col, vec_col, scale)
    model = fit(rows, dims, k)
    kind = dict(rows.dtypes)["id"]
    if model is None:
        empty = rows.where("false").select(F.col("id").alias(id_col), F.lit(None).cast("decimal(38,0)").alias("deviation"), F.array().cast("array<double>").alias("whitened"))
        return empty, None
    n, sums, w = model.n, model.sums, model.vectors / np.sqrt(model.values)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = _stacked(b["v"], dims)
            yield pd.DataFrame({"id": b["id"], "deviation": [Decimal(v) for v in deviations(x, n, sums)], "whitened": list(centred(x, n, sums) @ w)})

    out = rows.mapInPandas(run, f"id {kind}, deviation decimal(38,0), whitened array<double>")
    return out.withColumnRenamed("id", id_col), model
