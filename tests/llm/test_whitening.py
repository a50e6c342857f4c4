"""Whitening against numpy's own solver and whole-number sums."""

import math

import numpy as np
import pytest
from placeloom.llm import whitening
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("_x", T.StringType()),
    T.StructField("component", T.StringType())])


def symmetric(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    a = q @ np.diag(values) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize("a", [
    np.zeros((3, 3)), np.eye(5), np.diag([3.0, 3, 1, 1, 1]), np.array([[2.0]]), symmetric([7.0] * 20 + [2.0] * 20),
    symmetric(1 + 1e-9 * np.arange(40)), symmetric(10.0 ** -np.arange(30)), symmetric([1e8] + [1.0] * 40),
    symmetric(np.r_[np.zeros(30), np.arange(5.0)]), symmetric(np.r_[-3.0, -3.0, 5.0, 0.1]),
    *(np.cov(np.random.default_rng(s).normal(size=(64, 300))) for s in range(3))])
def test_spectrum(a):
    values, vectors = whitening.spectrum(a)
    size = max(np.linalg.norm(a), 1e-300)
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() <= 1e-13 * size
    assert np.linalg.norm(a @ vectors - vectors * values) <= 1e-12 * size
    assert np.linalg.norm(vectors.T @ vectors - np.eye(len(a))) <= 1e-12


def test_polar_factor_is_the_sign():
    a = symmetric(np.r_[-5.0, -1e-9, 1e-12, 2.0])
    u = whitening.polar_factor(a)
    assert np.linalg.norm(u @ u - np.eye(4)) < 1e-12
    assert round(np.trace(u)) == 0


def brute(rows, k=16):
    kept = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    mean = [s / n for s in sums]
    c = np.array([[a - m for a, m in zip(x, mean, strict=True)] for x in fit])
    v = c.T @ c / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    out = {}
    for i, x in kept:
        w = np.array([a - m for a, m in zip(x, mean, strict=True)]) @ vectors / np.sqrt(values)
        out.setdefault(i, []).append((sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), w))
    return n, out, values / np.trace(v)


def test_against_numpy(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 20)) * np.linspace(2, 0.5, 20)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)] + [(None, rows[9][1])]
    bad = [(2000, None), (2001, [None] + [0.0] * 19), (2002, [float("nan")] + [0.0] * 19), (2003, [float("-inf")] + [0.0] * 19), (2004, [1.0, 2.0]), (2005, [])]
    df = spark.createDataFrame([(i, v, "a", "b") for i, v in rows + bad], SCHEMA).repartition(5)
    n, expected, explained = brute(rows)
    found = whitening.whitened(df).collect()
    assert len(found) == 16 * len(rows)
    signs = {}
    for r in found:
        assert r.n == n and r.identity_error < 1e-9
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-10)
        deviation, w = expected[r.vec_id][0]
        assert r.deviation == deviation
        want = w[r.component - 1]
        if abs(want) > 1e-3:
            sign = signs.setdefault(r.component, np.sign(want * r.whitened))
            assert r.whitened == pytest.approx(sign * want, rel=1e-6, abs=1e-8)


def test_few_and_constant_vectors(spark):
    def run(vectors):
        return whitening.whitened(spark.createDataFrame([(i, v, "", "") for i, v in enumerate(vectors)], SCHEMA)).collect()

    assert run([]) == []
    assert run([None]) == []
    one = run([[1.0, 2.0, 3.0]] * 3)
    assert len(one) == 9 and all(r.whitened == 0 and r.explained == 0 and r.deviation == 0 and r.identity_error == 0 for r in one)
    two = run([[0.0, 0.0], [1.0, 1.0]])
    assert sorted((r.component, round(abs(r.whitened), 9), round(r.explained, 9)) for r in two) == [(1, 1, 1), (1, 1, 1), (2, 0, 0), (2, 0, 0)]
