"""Whitening against numpy."""

from __future__ import annotations

import numpy as np
import pytest

from promptloom.llm.queries import QUERIES
from promptloom.llm.whitening import Moments, _sums, symmetric_eigen, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, n long, component string"


def vectors(n=300, d=12, seed=1):
    r = np.random.default_rng(seed)
    return (r.normal(size=(n, d)) @ r.normal(size=(d, d)) / 4 + r.normal(size=d)).astype(np.float32)


def expected(c):
    x = np.floor(1024 * c.astype(float)).astype(np.int64) + 100_000
    n, total = len(x), x.sum(axis=0)
    far = [sum(int(v) ** 2 for v in n * row - total) for row in x]
    off = (n * x - total) / n
    values, vectors = np.linalg.eigh(off.T @ off / n)
    return far, off, values[::-1], vectors[:, ::-1]


def check(rows, c, ids):
    far, off, values, basis = expected(c)
    k = min(8, c.shape[1])
    assert len(rows) == k * len(c) and {r.n for r in rows} == {len(c)}
    got = np.zeros((len(c), k))
    at = {}
    for r in sorted(rows, key=lambda r: (str(r.vec_id), r.deviation, r.component)):
        at.setdefault(r.vec_id, []).append(r)
    for i, name in enumerate(ids):
        own = [r for r in at[name] if r.deviation == far[i]][:k]
        assert [r.component for r in own] == list(range(1, k + 1))
        got[i] = [r.whitened for r in own]
        assert all(abs(r.explained - values[r.component - 1] / values.sum()) < 1e-10 for r in own)
    want = off @ basis[:, :k] / np.sqrt(values[:k])
    signs = np.sign((got * want).sum(axis=0))
    assert np.abs(got * signs - want).max() < 1e-7
    (error,) = {r.identity_error for r in rows}
    cov = np.cov(got.T, bias=True)
    assert abs(error - np.abs(cov - np.eye(k)).max()) < 1e-9 and error < 1e-9


def test_whitening(spark):
    c = vectors()
    odd = [(900, None), (901, []), (902, [None] + [0.0] * 11), (903, [float("nan")] * 12), (904, [float("inf")] * 12), (905, [1.0] * 7), (906, [3e38] * 12)]
    rows = [(i, v.tolist()) for i, v in enumerate(c)] + odd
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], SCHEMA).repartition(7)
    check(whiten(df).collect(), c, list(range(len(c))))
    assert whiten(df.where("vec_id >= 900 and vec_id < 905")).collect() == [] and whiten(df.limit(0)).collect() == []


def test_repeated_rows_count_each(spark):
    c = vectors(40, 3)
    c = np.concatenate([c, c[:1], c[:1]])
    df = spark.createDataFrame([(None if i == 5 else 7 if i > 38 else i, v.tolist(), 1, 2, "x") for i, v in enumerate(c)], SCHEMA).repartition(3)
    rows = whiten(df).collect()
    assert len(rows) == 3 * len(c) and {r.n for r in rows} == {42} and sum(r.vec_id is None for r in rows) == 3
    far = sorted(r.deviation for r in rows if r.component == 1)
    assert far == sorted(expected(c)[0])


def test_components_without_variance_are_left_out(spark):
    df = spark.createDataFrame([(i, [float(i), 5.0, 2.0 * i], 1, 2, "x") for i in range(20)], SCHEMA)
    assert {r.component for r in whiten(df).collect()} == {1}
    assert whiten(df.where("vec_id = 3")).collect() == []


def test_deviations_that_are_no_long_are_null(spark):
    df = spark.createDataFrame([(i, [(-1.0) ** i * 2.0**40, float(i)], 1, 2, "x") for i in range(10)], SCHEMA)
    rows = whiten(df).collect()
    assert {r.deviation for r in rows} == {None} and all(abs(abs(r.whitened) - 1) < 1e-9 for r in rows if r.component == 1)


def test_moments_merge_in_any_order():
    r = np.random.default_rng(4)
    x = r.normal(size=(500, 5)) + 1e5
    parts = np.split(x, [0, 1, 90, 91, 300])
    whole, merged = Moments.none(5), Moments.none(5)
    whole.add(x)
    for p in reversed(parts):
        m = Moments.none(5)
        m.add(p)
        merged.merge(Moments.of(*m.row(0)[1:]))
    for m in (whole, merged):
        assert m.n == 500 and np.abs(m.mean - x.mean(axis=0)).max() < 1e-9 and np.abs(m.moments / 500 - np.cov(x.T, bias=True)).max() < 1e-9
    assert _sums(np.array([[1 << 62, 1], [1 << 62, 2]])) == [1 << 63, 3]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64])
def test_symmetric_eigen(n):
    r = np.random.default_rng(n)
    for a in (r.normal(size=(n, n)), np.eye(n), np.zeros((n, n)), np.diag(np.arange(n) // 2), np.outer(np.arange(n), np.arange(n))):
        a = (a + a.T) / 2
        values, vectors = symmetric_eigen(a)
        assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() < 1e-11 * max(1, np.abs(a).max() * n)
        assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-12 and np.abs(a @ vectors - vectors * values).max() < 1e-10 * max(1, np.abs(a).max() * n)


def test_query(spark, tmp_path):
    c = vectors(120, 9, 6)
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(c)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    check(QUERIES["op12_whitening"](spark, str(tmp_path)).collect(), c, list(range(120)))
