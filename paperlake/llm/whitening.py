"""Whitening of embeddings by principal components from FEAST contour integration.

Three passes over the vectors, each with partial sums in its tasks: counts and sums, the covariance of centred vectors, and
the projection. Between them stands the covariance matrix alone, whose size is the square of the dimension, whatever the
number of vectors (``MAX_DIMENSION`` bounds it). Its leading eigenpairs come from FEAST (Polizzi, 2009):

- ``inertia`` counts the eigenvalues above a shift by the signs of a symmetric factorisation (Bunch and Parlett, 1971).
  Bisection by these counts finds intervals that hold the leading eigenvalues, a few in each.
- For each interval the resolvent is integrated on a circle around it: solves with the complex shifted covariance at
  Gauss-Legendre points, applied to a block of vectors, project it onto the interval's eigenspace.
- Rayleigh-Ritz on that block gives eigenpairs; they go round again until their residuals are at the rounding level.
- The number of pairs found must equal the inertia counts, or ``MissingPairs`` is raised. A last Rayleigh-Ritz over the pairs of all
  intervals makes them orthogonal across borders.

Vectors that are null or hold null, NaN or infinite entries are dropped. The others must have one dimension (``ValueError``), and
their integers must fit the exact sums (``OverflowError``). Components with no variance to speak of (up to ``NEGLIGIBLE``
of the trace) aren't returned, so that equal vectors, a single vector or an empty table give no rows. Equal
eigenvalues have some orthonormal basis of their space. Repeated rows and null ids count as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

__all__ = ["MissingPairs", "Whitening", "feast", "fit_whitening", "inertia", "leading_intervals", "op12_whitening", "quantised", "whiten"]

MAX_DIMENSION = 4096
#: Share of the trace up to which a component has no variance to speak of.
NEGLIGIBLE = 1e-12
_SCALE, _SHIFT = 1024, 100_000
_NODES = 8
_ALPHA = (1 + 17**0.5) / 8


class MissingPairs(ArithmeticError):
    """Fewer or more eigenpairs than the inertia counts tell."""


def inertia(matrix: np.ndarray, shift: float) -> int:
    """Number of eigenvalues above ``shift`` of a symmetric matrix, by its factorisation with complete pivoting."""
    a = np.array(matrix, dtype=np.float64)
    a[np.diag_indices_from(a)] -= shift
    above = 0
    while (n := len(a)) > 0:
        diagonal = np.abs(np.diagonal(a))
        r = int(diagonal.argmax())
        off = np.abs(a)
        off[np.diag_indices_from(off)] = 0
        p, q = divmod(int(off.argmax()), n)
        if diagonal[r] == 0 and off[p, q] == 0:
            return above
        pivot = [r] if diagonal[r] >= _ALPHA * off[p, q] else [p, q]
        rest = np.setdiff1d(np.arange(n), pivot)
        block, cross = a[np.ix_(pivot, pivot)], a[np.ix_(rest, pivot)]
        above += int(block[0, 0] > 0) if len(pivot) == 1 else 1  # a block of two has one of each sign
        a = a[np.ix_(rest, rest)] - cross @ np.linalg.solve(block, cross.T)
        a = (a + a.T) / 2
    return above


def leading_intervals(matrix: np.ndarray, k: int, most: int = 4) -> list[tuple[float, float, int]]:
    """(low, high, count), falling, that hold the ``k`` largest eigenvalues of a positive semidefinite matrix, and those too near to tell from the last.

    Eigenvalues up to ``NEGLIGIBLE`` of the trace don't count.
    """
    top = float(np.abs(matrix).sum(axis=1).max()) * (1 + 1e-9)
    low, high, width = NEGLIGIBLE * float(np.trace(matrix)), top, 1e-13 * top
    count = inertia(matrix, low)
    k = min(k, count)
    while count > k and high - low > width:
        middle = (low + high) / 2
        c = inertia(matrix, middle)
        if c >= k:
            low, count = middle, c
        else:
            high = middle
    found, open_ = [], [(low, top, count, 0)]
    while open_:
        a, b, above_a, above_b = open_.pop()
        if above_a - above_b <= most or b - a <= 64 * width:
            if above_a > above_b:
                found.append((a, b, above_a - above_b))
            continue
        middle = (a + b) / 2
        above = inertia(matrix, middle)
        open_ += [(middle, b, above, above_b), (a, middle, above_a, above)]
    return sorted(found, reverse=True)


def _ritz(matrix: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rayleigh-Ritz values and vectors on the space of a block's columns."""
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    basis = u[:, s > 1e-13 * max(s.max(initial=0), 1e-300)]
    values, inner = np.linalg.eigh(basis.T @ matrix @ basis)
    return values, basis @ inner


def feast(matrix: np.ndarray, low: float, high: float, count: int, rounds: int = 80, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues of a symmetric matrix between ``low`` and ``high``, and their vectors as columns."""
    n, norm = len(matrix), float(np.abs(matrix).sum(axis=1).max())
    columns = min(n, 2 * count + 4)
    block = np.random.default_rng(seed).standard_normal((n, columns))
    x, w = np.polynomial.legendre.leggauss(_NODES)
    turn = np.exp(-0.5j * np.pi * (x - 1))
    middle, radius = (low + high) / 2, max((high - low) / 2, 1e-12 * norm)
    best = np.inf
    for _ in range(rounds):
        projected = np.zeros_like(block)
        for at, weight in zip(turn, w, strict=True):
            solved = np.linalg.solve((middle + radius * at) * np.eye(n) - matrix, block.astype(complex))
            projected += weight / 2 * (radius * at * solved).real
        values, block = _ritz(matrix, projected)
        inside = (values > low) & (values <= high)
        residual = np.abs(matrix @ block[:, inside] - block[:, inside] * values[inside]).max(initial=0) / norm
        if inside.sum() == count and (residual <= 4e-16 or residual <= 1e-13 and residual >= 0.5 * best):
            return values[inside], block[:, inside]
        best = min(best, residual) if inside.sum() == count else np.inf
    raise MissingPairs(f"{int(inside.sum())} eigenpairs of {count} between {low} and {high}, residual {residual:.1e}")


@dataclass(frozen=True)
class Whitening:
    """Count and sums of the fit list, its leading components as columns, their eigenvalues and the trace."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return x - self.sums / self.n

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.values)


def _complete(vectors: DataFrame) -> DataFrame:
    odd = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.filter(F.col("embedding").isNotNull() & ~odd)


def quantised(vectors: pa.Array, dimension: int | None = None) -> np.ndarray:
    """Rows of integers ``floor(1024 c) + 100000`` of a list array."""
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    dimension = int(lengths[0]) if dimension is None and len(lengths) else dimension or 0
    if (lengths != dimension).any():
        raise ValueError(f"vectors of {int(lengths[lengths != dimension][0])} entries among those of {dimension}")
    flat = pc.list_flatten(vectors).to_numpy(zero_copy_only=False).astype(np.float64)
    flat = np.floor(flat * _SCALE)
    if np.abs(flat).max(initial=0) >= 2.0**52:
        raise OverflowError("entries beyond 2 ** 42")
    return (flat.astype(np.int64) + _SHIFT).reshape(len(lengths), dimension)


def _summed(vectors: DataFrame, partial: Callable[[np.ndarray], np.ndarray], kind: pa.DataType, ddl: str, width: int | None) -> list:
    """(at, sum, count of vectors) of what ``partial`` gives for batches, flat; tasks add theirs first, Spark the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count, size = None, 0, width
        for b in batches:
            if b.num_rows:
                x = quantised(b.column("embedding"), size)
                size = x.shape[1]
                part = partial(x)
                total = part if total is None else total + part
                count += len(x)
        if total is not None:
            flat = total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int64()), pa.array(flat, kind), pa.array(np.full(len(flat), count), pa.int64())], ["at", "v", "n"])

    parts = vectors.select("embedding").mapInArrow(run, f"at long, v {ddl}, n long")
    return parts.groupBy("at").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).orderBy("at").collect()


def fit_whitening(vectors: DataFrame, k: int = 8) -> Whitening | None:
    """Leading ``k`` components of all complete vectors of column ``embedding``; None if there are none with variance."""
    complete = _complete(vectors)
    low, high = complete.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if not high:
        return None
    if low != high or high > MAX_DIMENSION:
        raise ValueError(f"vectors of {low} to {high} entries; one dimension up to {MAX_DIMENSION} is asked for")
    sums = _summed(complete, lambda x: x.sum(axis=0), pa.int64(), "long", high)
    n, total = sums[0]["n"], np.array([r["v"] for r in sums], dtype=np.int64)
    mean = total / n

    def products(x: np.ndarray) -> np.ndarray:
        y = x - mean
        return y.T @ y

    flat = np.array([r["v"] for r in _summed(complete, products, pa.float64(), "double", high)])
    covariance = flat.reshape(high, high) / n
    covariance = (covariance + covariance.T) / 2
    trace = float(np.trace(covariance))
    if trace <= 0:
        return None
    pairs = [feast(covariance, *x) for x in leading_intervals(covariance, k)]
    values, basis = _ritz(covariance, np.hstack([p[1] for p in pairs]))
    order = np.argsort(-values, kind="stable")[:k]
    order = order[values[order] > NEGLIGIBLE * trace]
    components = basis[:, order]
    components = components * np.where(components[np.abs(components).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    return Whitening(n, total, components, values[order], trace) if len(order) else None


def _identity_error(complete: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity."""
    k, dimension = len(model.values), len(model.sums)
    means = _summed(complete, lambda x: model.project(x).sum(axis=0), pa.float64(), "double", dimension)
    mean = np.array([r["v"] for r in means]) / model.n

    def products(x: np.ndarray) -> np.ndarray:
        w = model.project(x) - mean
        return w.T @ w

    flat = np.array([r["v"] for r in _summed(complete, products, pa.float64(), "double", dimension)])
    return float(np.abs(flat.reshape(k, k) / model.n - np.eye(k)).max())


def _deviations(x: np.ndarray, model: Whitening) -> np.ndarray:
    """Exact sums of squares of ``n x - S``."""
    if float(np.square(model.n * x.astype(np.float64) - model.sums).sum(axis=1).max(initial=0)) >= 2.0**62:
        raise OverflowError("squared deviations leave 64 bits")
    return np.square(model.n * x - model.sums).sum(axis=1)


_KIND = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])
_DDL = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, model: Whitening) -> DataFrame:
    """A row for each complete vector (vec_id, embedding) and component."""
    complete = _complete(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
    error, k = _identity_error(complete, model), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = quantised(b.column("embedding"), len(model.sums))
            rows = len(x) * k
            ids = b.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), k)))
            columns = [ids, np.tile(np.arange(1, k + 1), len(x)), np.full(rows, model.n), np.repeat(_deviations(x, model), k), model.project(x).ravel(), np.tile(model.values / model.trace, len(x)), np.full(rows, error)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, np.ndarray) else c for c, f in zip(columns, _KIND, strict=True)], schema=_KIND)

    return complete.mapInArrow(run, _DDL)


def op12_whitening(embeddings: DataFrame) -> DataFrame:
    """All complete vectors on their eight leading components, scaled to unit variance."""
    model = fit_whitening(embeddings)
    if model is None:
        return embeddings.sparkSession.createDataFrame([], _DDL)
    return whiten(embeddings, model)
