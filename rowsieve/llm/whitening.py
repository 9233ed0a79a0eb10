"""Whitening of embeddings by refined eigenvectors of their covariance.

Sums and the covariance are gathered by Spark, one small matrix a task. Its eigenvectors
begin as those of 32-bit numbers and are corrected by matrix products in extended
precision, which double their digits each time. Eigenvalues too close to be told apart
so are solved among themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsieve.llm.vectors import matrix, whole_vectors

SHIFT = 100_000
COMPONENTS = 8
#: Rounds of corrections, and of sub-solves; both end as soon as nothing changes.
ROUNDS, SOLVES = 12, 6
#: An eigenvalue below this share of the largest counts as none.
NONE = 1e-13
WIDE = np.longdouble
LARGEST = (1 << 63) - 1


@dataclass(frozen=True)
class Whitening:
    """The fit: rows, sum of each dimension, unit eigenvectors (columns), eigenvalues, their total."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    total: float

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact."""
        return self.n * x - self.sums

    def whitened(self, deviations: np.ndarray) -> np.ndarray:
        """Rows on the components, over the root of their eigenvalues; 0 where there is no variance."""
        with np.errstate(divide="ignore"):
            scale = np.where(self.values > 0, 1 / np.sqrt(self.values), 0.0)
        return (deviations / self.n) @ self.vectors * scale


def _correct(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One correction of the eigenvectors ``x``: vectors, values, how near counts as equal, largest step."""
    near = np.eye(len(a), dtype=WIDE) - x.T @ x
    s = x.T @ (a @ x)
    s = (s + s.T) / 2  # else rounding over a small gap would spoil orthogonality
    values = np.diag(s) / (1 - np.diag(near))
    off = s - np.diag(np.diag(s))
    limit = 2 * (np.linalg.norm(off.astype(float)) + np.linalg.norm(a.astype(float)) * np.linalg.norm(near.astype(float)))
    gaps = values[None, :] - values[:, None]
    # Below the root of the last digit, rounding over the gap would be no small step.
    apart = np.abs(gaps) > max(limit, float(np.sqrt(np.finfo(WIDE).eps)))
    step = np.where(apart, (s + values[None, :] * near) / np.where(apart, gaps, 1), near / 2)
    return x + x @ step, values, float(limit), float(np.abs(step).max())


def _settled(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Corrections until their steps are at the last digit, or neither they nor the limit fall."""
    last = (np.inf, np.inf)
    for _ in range(ROUNDS):
        x, values, limit, step = _correct(a, x)
        if step < np.finfo(WIDE).eps * 4 or step >= last[0] / 2 and limit >= last[1] / 2:
            break
        last = step, limit
    return x, values, limit


def _clusters(values: np.ndarray, limit: float) -> list[np.ndarray]:
    """Runs of eigenvalues, sorted, that are no further apart than ``limit``."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > limit) + 1
    return [run for run in np.split(order, cuts) if len(run) > 1]


def _closeness(values: np.ndarray, a: np.ndarray, limit: float) -> float:
    """Values nearer than this share a sub-solve: 32-bit vectors do not part them well."""
    return max(limit, float(np.abs(values).max(initial=0)) * np.sqrt(len(a)) * float(np.finfo(np.float32).eps))


def refined_eigh(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of the symmetric ``a``, falling, and unit eigenvectors (columns), to double precision.

    The 32-bit eigenvectors are corrected until they settle. Vectors of clustered values
    span the right space but are any mixture inside it: there the small matrix of the
    cluster, less its mean value and scaled, is solved by itself, and the result is
    corrected again. Equal eigenvalues leave any orthonormal vectors of their space.
    """
    a = np.asarray(a, WIDE)
    scale = np.abs(a).max(initial=0)
    if not scale:
        return np.zeros(len(a)), np.eye(len(a))
    a = (a + a.T) / (2 * scale)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(WIDE)
    x, values, limit = _settled(a, x)
    for _ in range(SOLVES):
        clusters = _clusters(values, _closeness(values, a, limit))
        if not clusters:
            break
        for run in clusters:
            part = x[:, run]
            middle = values[run].mean()
            inner = part.T @ (a @ part) - middle * (part.T @ part)
            size = np.abs(inner).max()
            if size:
                inner = ((inner + inner.T) / (2 * size)).astype(float)
                x[:, run] = part @ np.linalg.eigh(inner)[1].astype(WIDE)
        before = limit
        x, values, limit = _settled(a, x)
        if limit >= before / 2:
            break
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.sqrt((x[:, order] ** 2).sum(axis=0))
    return (values[order] * scale).astype(float), x.astype(float)


def _gathered(df: DataFrame, add: Callable[[dict, pa.RecordBatch], None], kind: str) -> list:
    """Rows (key, total) of what ``add`` sums up by key in each task, summed over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict = {}
        for batch in batches:
            if batch.num_rows:
                add(totals, batch)
        if totals:
            found = [(f"{name}:{k}", v) for name, values in totals.items() for k, v in enumerate(np.ravel(values).tolist())]
            keys, values = zip(*found, strict=True)
            yield pa.RecordBatch.from_pydict({"key": keys, "total": pa.array(values, pa.int64() if kind == "long" else pa.float64())})

    return df.mapInArrow(run, f"key string, total {kind}").groupBy("key").agg(F.sum("total").alias("total")).collect()


def _series(rows: list, name: str, size: int, kind) -> np.ndarray:
    out = np.zeros(size, kind)
    for key, total in rows:
        label, _, k = key.partition(":")
        if label == name:
            out[int(k)] = total
    return out


def fit_whitening(embeddings: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The fit over all whole vectors; None if there are none or they have no components.

    The driver gets sums of the size of a vector, and a matrix of that size squared.
    """
    rows = whole_vectors(embeddings, SHIFT)
    sized = rows.agg(F.count("*"), F.max(F.size("vec"))).first()
    n, dims = sized[0], sized[1] or 0
    if not n or not dims:
        return None

    def add_sums(totals, batch):
        totals["sum"] = totals.get("sum", 0) + matrix(batch.column("vec"), dims, SHIFT).sum(axis=0)

    fit = Whitening(n, _series(_gathered(rows, add_sums, "long"), "sum", dims, np.int64), np.empty((dims, 0)), np.empty(0), 0.0)

    def add_products(totals, batch):
        centred = fit.deviations(matrix(batch.column("vec"), dims, SHIFT)) / n
        totals["product"] = totals.get("product", 0) + (centred.T @ centred)

    products = _series(_gathered(rows, add_products, "double"), "product", dims * dims, float).reshape(dims, dims) / n
    values, vectors = refined_eigh(products)
    total = float(np.trace(products))
    values = np.where(values > NONE * values[:1].max(initial=0), values, 0.0)
    return Whitening(n, fit.sums, vectors[:, :components], values[:components], total)


def identity_error(embeddings: DataFrame, fit: Whitening) -> float:
    """Largest entry of the whitened rows' covariance less the identity, over components with variance."""
    dims, kept = len(fit.sums), fit.values > 0

    def add(totals, batch):
        found = fit.whitened(fit.deviations(matrix(batch.column("vec"), dims, SHIFT)))[:, kept]
        totals["sum"] = totals.get("sum", 0) + found.sum(axis=0)
        totals["product"] = totals.get("product", 0) + (found.T @ found)

    m = int(kept.sum())
    if not m:
        return 0.0
    rows = _gathered(whole_vectors(embeddings, SHIFT), add, "double")
    mean = _series(rows, "sum", m, float) / fit.n
    found = _series(rows, "product", m * m, float).reshape(m, m) / fit.n - np.outer(mean, mean)
    return float(np.abs(found - np.eye(m)).max())


def _squares(deviations: np.ndarray) -> list[int | None]:
    """Sums of squares; None beyond a long."""
    largest = int(np.abs(deviations).max(initial=0))
    if largest * largest * deviations.shape[1] <= LARGEST:
        return (deviations * deviations).sum(axis=1).tolist()
    found = (sum(int(x) * int(x) for x in row) for row in deviations.tolist())
    return [x if x <= LARGEST else None for x in found]


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component.

    A null vector, or one with a null, NaN or infinite entry, drops its row; a null vec_id
    stays. Shorter vectors go on with entries of zero. Repeated rows count and come back
    each time. A component without variance (all vectors equal, or fewer of them than
    dimensions) is whitened to 0 and explains 0; ``identity_error`` leaves it out. Ties
    between eigenvalues leave any orthonormal choice, the same for all rows. A deviation
    that no long holds is null. An empty table, or one without entries, gives no rows.
    Other columns play no part.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit = fit_whitening(embeddings, components)
    if fit is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    error = identity_error(embeddings, fit)
    dims, m = len(fit.sums), len(fit.values)
    explained = fit.values / fit.total if fit.total else np.zeros(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away = fit.deviations(matrix(batch.column("vec"), dims, SHIFT))
            rows = len(away)
            each = np.repeat(np.arange(rows), m)
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": batch.column("vec_id").take(pa.array(each)),
                    "component": pa.array(np.tile(np.arange(1, m + 1), rows), pa.int32()),
                    "n": pa.array(np.full(rows * m, fit.n)),
                    "deviation": pa.array(_squares(away), pa.int64()).take(pa.array(each)),
                    "whitened": pa.array(fit.whitened(away).ravel()),
                    "explained": pa.array(np.tile(explained, rows)),
                    "identity_error": pa.array(np.full(rows * m, error)),
                }
            )

    return whole_vectors(embeddings, SHIFT).mapInArrow(run, schema)
