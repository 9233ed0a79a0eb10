"""Refined eigenvectors and whitened rows, against plain double-precision numpy and exact sums."""

import math

import numpy as np
import pytest
from helpers import SF

from rowsieve.llm.queries import QUERIES
from rowsieve.llm.whitening import refined_eigh, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, n long, component int, key string, vec string"


def embeddings(spark, rows):
    """Vectors with columns that clash with names used inside."""
    return spark.createDataFrame([(i, v, 1, 5, 6, "k", "v") for i, v in rows], SCHEMA)


def whole(rows):
    kept = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dims = max((len(v) for _, v in kept), default=0)
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in [*v, *[0.0] * (dims - len(v))]] for _, v in kept]
    return [i for i, _ in kept], np.array(x, np.int64).reshape(len(kept), dims)


def spectrum(case, d=48):
    rng = np.random.default_rng(case)
    e = np.sort(rng.random(d) * 1e4)[::-1].copy()
    if case == 1:
        e[:6] = e[0] * (1 + 1e-9 * np.arange(6)[::-1])
    elif case == 2:
        e[:6] = e[0]
    elif case == 3:
        e[20:] = 0
    elif case == 4:
        e[:10] = e[0] * (1 - 1e-7 * np.arange(10))
        e[20:24] = e[20]
    q = np.linalg.qr(rng.normal(size=(d, d)))[0]
    a = (q * e) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize("case", range(5))
def test_eigenvectors_to_double_precision(case):
    """Plain, clustered, equal and missing eigenvalues."""
    a = spectrum(case)
    values, x = refined_eigh(a)
    top = values[0]
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() < 1e-14 * top
    assert np.abs(x.T @ x - np.eye(len(a))).max() < 1e-14
    assert np.abs(a @ x - x * values).max() < 2e-15 * top


def test_close_eigenvectors_are_told_apart():
    """Two values 1e-9 apart, beyond 32-bit numbers: the vectors are those put in, as far as doubles tell."""
    q = np.linalg.qr(np.random.default_rng(9).normal(size=(30, 30)))[0].astype(np.longdouble)
    q = q @ (1.5 * np.eye(30) - 0.5 * (q.T @ q))
    e = np.array([1.0, 1.0 - 1e-6, *np.linspace(0.5, 0.1, 28)], np.longdouble)
    x = refined_eigh((q * e) @ q.T)[1]
    assert np.abs(np.abs((x[:, :2] * q[:, :2].astype(float)).sum(axis=0)) - 1).max() < 1e-12
    assert np.abs(x[:, 0] @ q[:, 1].astype(float)) < 1e-11


@pytest.mark.parametrize("matrix", [np.zeros((0, 0)), np.zeros((3, 3)), np.array([[4.0]]), np.eye(5)])
def test_plain_matrices(matrix):
    values, x = refined_eigh(matrix)
    assert np.allclose(values, np.sort(np.diag(matrix))[::-1]) and np.allclose(x.T @ x, np.eye(len(matrix)))


def check(got, rows, components=8):
    ids, x = whole(rows)
    n, sums = len(x), x.sum(axis=0)
    away = [sum(int(v) ** 2 for v in row) for row in (n * x - sums).tolist()]
    m = min(components, x.shape[1])
    assert sorted(((r.vec_id, r.n, r.deviation) for r in got), key=repr) == sorted(
        ((i, n, d) for i, d in zip(ids, away) for _ in range(m)), key=repr
    )
    covariance = np.cov((x - sums / n).T, bias=True).reshape(x.shape[1], -1)
    values = np.linalg.eigvalsh(covariance)[::-1]
    total = np.trace(covariance)
    for r in got:
        assert math.isclose(r.explained, max(values[r.component - 1], 0) / total if total else 0, rel_tol=1e-4, abs_tol=1e-12)
        assert r.identity_error < 1e-4
    return values


AWKWARD = [
    (0, [1.0, 2.0, 0.5]),
    (0, [1.0, 2.0, 0.5]),
    (1, None),
    (2, [None, 1.0, 1.0]),
    (3, [float("nan"), 1.0, 1.0]),
    (4, [float("-inf"), 1.0, 1.0]),
    (None, [0.0, -3.0, 0.25]),
    (5, [0.25]),
    (6, []),
    (7, [-1.0, 1.0, 3.0]),
]


@pytest.mark.parametrize(
    "rows", [[], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5, AWKWARD],
    ids=["empty", "null", "no entries", "one", "all equal", "awkward"],
)
def test_awkward_rows(spark, rows):
    got = whiten(embeddings(spark, rows)).collect()
    if not whole(rows)[1].size:
        assert got == []
        return
    check(got, rows)
    if len(set(map(str, rows))) == 1:
        assert {r.whitened for r in got} == {0.0}


def test_whitened_rows(spark):
    """Against eigenvectors of numpy in double precision, up to their sign."""
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = QUERIES["op13_whitening"](spark, SF).collect()
    check(got, rows)
    ids, x = whole(rows)
    vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    plain = (x - x.mean(axis=0)) @ vectors[1][:, ::-1][:, :8] / np.sqrt(vectors[0][::-1][:8])
    mine = np.array([[r.whitened for r in sorted((r for r in got if r.vec_id == i), key=lambda r: r.component)] for i in ids])
    sign = np.sign((plain * mine).sum(axis=0))
    assert np.abs(plain - mine * sign).max() < 1e-10
