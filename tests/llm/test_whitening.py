"""Whitening against a dense decomposition."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pytest

from tidewell.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<double>, n long, component string, x int"


def table(spark, vectors, start=0):
    return spark.createDataFrame([(start + k if k is not None else None, v, None, None, None) for k, v in enumerate(vectors)], SCHEMA).repartition(3)


def check(rows, vectors, most=32):
    """rows of whitened() over the valid vectors of one length, by vec_id, against numpy."""
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors.values()], dtype=np.int64)
    n = len(x)
    d = n * x - x.sum(axis=0)
    c = d / n
    values, vec = np.linalg.eigh(c.T @ c / n)
    values, vec = values[::-1], vec[:, ::-1]
    k = min(most, int((values > 1e-12 * values[0]).sum()))
    by = defaultdict(dict)
    for r in rows:
        by[r.vec_id][r.component] = r
    assert set(by) == set(vectors) and all(sorted(b) == list(range(1, k + 1)) for b in by.values())
    got = np.array([[by[i][j + 1].whitened for j in range(k)] for i in vectors])
    for at, i in enumerate(vectors):
        one = by[i][1]
        assert (one.n, one.deviation) == (n, int((d[at].astype(object) ** 2).sum()))
    assert np.allclose([by[next(iter(vectors))][j + 1].explained for j in range(k)], values[:k] / values.sum(), rtol=1e-6)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-7
    spread = np.cov(got.T, bias=True).reshape(k, k)
    assert abs(spread - np.eye(k)).max() < 1e-7
    for j in range(k):  # components that stand alone are numpy's, up to their sign
        if all(abs(values[j] - values[m]) > 1e-3 * values[0] for m in (j - 1, j + 1) if 0 <= m < len(values)):
            want = c @ vec[:, j] / np.sqrt(values[j])
            assert min(abs(got[:, j] - want).max(), abs(got[:, j] + want).max()) < 1e-6
    span = vec[:, :k] @ vec[:, :k].T
    if k == len(values) or values[k - 1] - values[k] > 1e-3 * values[0]:  # and all of them span what numpy's span
        assert np.allclose((got * np.sqrt([by[next(iter(vectors))][j + 1].explained * values.sum() for j in range(k)])) ** 2 @ np.ones(k), ((c @ span) ** 2).sum(axis=1), rtol=1e-6, atol=1e-9)


@pytest.mark.parametrize("n,dim", [(300, 64), (20, 48), (50, 3), (120, 40)])
def test_against_numpy(spark, n, dim):
    rng = np.random.default_rng(n)
    vectors = dict(enumerate((rng.normal(size=(n, dim)) * np.linspace(3, 0.2, dim)).tolist()))
    check(wh.whitened(table(spark, vectors.values())).collect(), vectors)


def test_ties_constant_and_repeated_dimensions(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2, size=(200, 6)).astype(float)
    full = np.hstack([a, a[:, :2], np.full((200, 3), 5.0), 1e3 * rng.normal(size=(200, 1))])
    vectors = dict(enumerate(full.tolist()))
    check(wh.whitened(table(spark, vectors.values())).collect(), vectors)


def test_a_short_basis_restarts():
    rng = np.random.default_rng(2)
    for spread in (np.linspace(1, 2, 300), np.r_[np.ones(290), np.linspace(2, 9, 10)], np.r_[np.zeros(280), np.linspace(1, 5, 20)], np.zeros(300)):
        q = np.linalg.qr(rng.normal(size=(300, 300)))[0]
        m = (q * spread) @ q.T
        rounds = []
        values, vec = wh.block_lanczos(lambda b: rounds.append(1) or m @ b, 300, 8, columns=56)
        assert np.allclose(values, np.sort(spread)[::-1][:8], atol=1e-9)
        assert np.abs(m @ vec - vec * values).max() < 1e-9 and np.allclose(vec.T @ vec, np.eye(8), atol=1e-9)


def test_breakdown_goes_on():
    """The first block spans an invariant space that lacks the greatest eigenvalue."""
    m = np.diag([1.0] * 60 + [5.0])
    first = np.linalg.qr(np.eye(61)[:, :10])[0]
    values, _ = wh.block_lanczos(lambda b: m @ b, 61, 2)
    assert np.allclose(values, [5, 1]) and first.shape == (61, 10)


def test_null_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    good = {k: v for k, v in enumerate(rng.normal(size=(40, 5)).tolist())}
    short = {100 + k: v for k, v in enumerate(rng.normal(size=(9, 2)).tolist())}
    odd = [(200, None), (201, []), (202, [1.0, None, 2.0, 3.0, 4.0]), (203, [math.nan] * 5), (204, [math.inf, 0.0, 0.0, 0.0, 0.0])]
    same = {300: [1.0, 2.0, 3.0], 301: [1.0, 2.0, 3.0]}
    rows = [(i, v, None, None, None) for i, v in [*good.items(), *short.items(), *odd, *same.items()]]
    out = wh.whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    check([r for r in out if r.vec_id < 100], good)
    check([r for r in out if 100 <= r.vec_id < 200], short)
    assert not [r for r in out if r.vec_id >= 200]
    assert wh.whitened(spark.createDataFrame([], SCHEMA)).count() == 0
    again = wh.whitened(spark.createDataFrame([(None, v, None, None, None) for v in good.values()] + rows[:1], SCHEMA)).collect()
    assert len(again) == 41 * 5 and {r.n for r in again} == {41}


def test_very_great_entries(spark):
    vectors = {0: [1e300, 0.0], 1: [-1e300, 1.0], 2: [3e9, 5.0], 3: [2.0, 1e12]}
    rows = wh.whitened(table(spark, vectors.values())).collect()
    assert {r.vec_id for r in rows} == set(vectors) and {r.deviation for r in rows} == {None}
    vectors = dict(enumerate(np.random.default_rng(4).integers(-(10**6), 10**6, size=(10, 3)).astype(float).tolist()))
    check(wh.whitened(table(spark, vectors.values())).collect(), vectors)


def test_query(spark, sf):
    valid = {r.vec_id: list(r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect() if r.embedding and all(v is not None and math.isfinite(v) for v in r.embedding)}
    check(wh.op11_whiten(spark, sf).collect(), valid)


def test_passes_are_one_job_each_whatever_the_partitions(spark):
    """Sums came to the driver by a job for each partition of the shuffle."""
    vectors, jobs = table(spark, np.random.default_rng(6).normal(size=(30, 3)).tolist()), {}
    sc, before = spark.sparkContext, {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for n in (2, 16):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            sc.setJobGroup(f"whitening {n}", "")
            check(wh.whitened(vectors).collect(), dict(enumerate(r.embedding for r in vectors.sort("vec_id").collect())))
            jobs[n] = len(sc.statusTracker().getJobIdsForGroup(f"whitening {n}"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert jobs[16] == jobs[2] > 0
