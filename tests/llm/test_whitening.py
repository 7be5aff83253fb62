"""Whitening against a full eigendecomposition of the covariance."""

import math
from collections import defaultdict

import numpy as np
import pytest

from routeloom.llm import whitening


def brute(vectors, d):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] + [1_000_000] * (d - len(v)) for v in vectors], dtype=object)
    n, s = len(x), x.sum(0)
    deviation = [sum((n * a - b) ** 2 for a, b in zip(r, s)) for r in x]
    centred = np.array([[float((n * a - b)) / n for a, b in zip(r, s)] for r in x])
    e, q = np.linalg.eigh(centred.T @ centred / n)
    return deviation, centred, e[::-1], q[:, ::-1]


def check(got, ids, vectors, d, k, distinct=True):
    deviation, centred, e, q = brute(vectors, d)
    rank = int((e > 1e-14 * e[0]).sum())
    by = defaultdict(dict)
    for r in got:
        by[r.id][r.component] = r
    assert sorted(by) == sorted(ids) and all(sorted(c) == list(range(1, min(k, rank) + 1)) for c in by.values())
    assert {(r.id, r.n, r.deviation) for r in got} == {(i, len(ids), min(x, 2**63 - 1)) for i, x in zip(ids, deviation)}
    white = np.array([[by[i][c].whitened for c in range(1, min(k, rank) + 1)] for i in ids])
    assert np.abs(white.T @ white / len(ids) - np.eye(white.shape[1])).max() < 1e-9
    assert got[0].identity_error < 1e-9
    assert np.allclose([by[ids[0]][c].explained for c in range(1, white.shape[1] + 1)], e[: white.shape[1]] / e.sum(), rtol=1e-10)
    if distinct:
        expected = centred @ q[:, : white.shape[1]] / np.sqrt(e[: white.shape[1]])
        signs = np.sign((white * expected).sum(0))
        assert np.abs(white - expected * signs).max() < 1e-7


@pytest.mark.parametrize("kind", ["flat", "falling", "low rank", "equal values", "few rows"])
def test_components(spark, kind):
    r = np.random.default_rng(3)
    n, d, k = (7, 10, 5) if kind == "few rows" else (300, 12, 5)
    v = r.standard_normal((n, d))
    if kind == "falling":
        v *= 4.0 ** -np.arange(d) * 1000
    if kind == "low rank":
        v = np.floor(64 * v) / 64
        v[:, 3:] = v[:, [0]] * 2
    if kind == "equal values":  # +-1 along each axis: all eigenvalues are one
        v = np.concatenate([np.eye(d), -np.eye(d)])
    v = v.tolist()
    ids = list(range(len(v)))
    got = whitening.whiten(spark.createDataFrame(list(zip(ids, v)), "id long, v array<double>"), k).collect()
    check(got, ids, v, d, k, kind != "equal values")


def test_stops_early_only_where_nothing_can_be_missed(spark, monkeypatch):
    r = np.random.default_rng(4)
    v = (r.standard_normal((200, 30)) * 8.0 ** -np.arange(30) * 1e6).tolist()
    passes = []
    real = whitening.summed
    monkeypatch.setattr(whitening, "summed", lambda *a: passes.append(1) or real(*a))
    ids = list(range(200))
    check(whitening.whiten(spark.createDataFrame(list(zip(ids, v)), "id long, v array<double>"), 2).collect(), ids, v, 30, 2)
    assert len(passes) < 25


def test_awkward_vectors(spark):
    """Nulls, non-finite entries, short and empty vectors, null and repeated ids, extra columns; nothing of no variance."""
    r = np.random.default_rng(5)
    good = [(i, r.standard_normal(4).tolist()) for i in range(20)] + [(20, [1.0, 2.0]), (21, [])]
    bad = [(30, None), (31, [1.0, None, 0.0, 0.0]), (32, [float("nan"), 0.0, 0.0, 0.0]), (33, [float("inf")] * 4)]
    schema = "id long, v array<float>, component string, n string"
    rows = [(i, v, "x", "y") for i, v in good + bad]
    got = whitening.whiten(spark.createDataFrame(rows, schema).select("id", "v")).collect()
    check(got, [i for i, _ in good], [[float(np.float32(c)) for c in v] for _, v in good], 4, 32)
    twice = whitening.whiten(spark.createDataFrame([(None, v) for _, v in good[:6]] * 2, "id long, v array<double>"), 2).collect()
    assert len(twice) == 24 and all(x.id is None and x.n == 12 for x in twice)
    huge = whitening.whiten(spark.createDataFrame([(1, [1e30, 0.0]), (2, [0.0, 1.0])], "id long, v array<double>")).collect()
    assert {x.deviation for x in huge} == {2**63 - 1} and len(huge) == 2
    for some in ([], good[:1], good[:1] * 3, bad, [(1, [])]):
        assert whitening.whiten(spark.createDataFrame(some, "id long, v array<float>")).collect() == []


def test_query(spark):
    got = whitening.op13_whiten(spark, "/root/testdata/sf0.001").toPandas()
    assert list(got.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert len(got) == 500 * 32 and got.identity_error.max() < 1e-9
