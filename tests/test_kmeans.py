"""Training with bounds against plain Lloyd rounds in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiver.operators import kmeans as K


def frame(spark, x, parts=3):
    rows = [(i, [float(c) for c in v] if v is not None else None) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)


def plain(df, nlist, seed, max_iterations=100):
    """(centroids, rounds, converged) of Lloyd rounds over all vectors, empty clusters seeded anew in seeded order."""
    rows = sorted(((r.vec_id, r.embedding) for r in df.where("embedding is not null").collect()))
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows])
    order = [r.vec_id for r in K.kmeans_init(df.where("embedding is not null"), nlist, seed).orderBy("cluster_id").collect()]
    cent, near, moved = x[[ids.index(i) for i in order]], np.zeros(len(x), int), False
    for it in range(max_iterations):
        d = np.zeros((len(x), nlist))
        for j in range(x.shape[1]):
            d += (x[:, j, None] - cent[None, :, j]) ** 2
        now = np.sqrt(d).argmin(axis=1)
        moved, near = bool((now != near).any()), now
        new = np.array([x[near == c].mean(axis=0) if (near == c).any() else np.full(x.shape[1], np.nan) for c in range(nlist)])
        empty = [c for c in range(nlist) if not (near == c).any()]
        for r in K.reseed_empty(df.where("embedding is not null"), empty, seed, it + 1).collect() if empty else []:
            new[r.cluster_id] = r.centroid
        if not moved or K.relative_change(cent, new) < K.CONVERGENCE_THRESHOLD:
            return new, it + 1, True
        cent = new
    return cent, max_iterations, False


def trained(res):
    return np.array([r.centroid for r in res.centroids.orderBy("cluster_id").collect()])


def blobs(n, k, dim, seed, spread=0.1):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(k, dim))[rng.integers(0, k, n)] + spread * rng.normal(size=(n, dim))


@pytest.mark.parametrize("name, x, nlist", [
    ("blobs", blobs(400, 6, 8, 1), 6),
    ("no structure", np.random.default_rng(2).normal(size=(300, 5)), 7),
    ("ties", np.random.default_rng(3).integers(0, 3, (200, 2)).astype(float), 5),
    ("one cluster", blobs(60, 3, 4, 4), 1),
    ("as many as rows", blobs(12, 3, 4, 5), 12),
    ("with nulls", [*blobs(80, 4, 3, 6), None, None], 4),
])
def test_training_equals_plain_rounds(spark, name, x, nlist):
    df = frame(spark, list(x))
    for seed in (42, 7):
        res = K.kmeans_train(df, nlist, seed=seed)
        want, rounds, converged = plain(df, nlist, seed)
        assert (res.iterations, res.converged) == (rounds, converged)
        assert np.allclose(trained(res), want, rtol=0, atol=1e-12)


def test_empty_clusters_are_seeded_anew(spark):
    x = np.repeat([[0.0, 0.0], [0.0, 0.0], [10.0, 0.0], [10.0, 1.0]], 6, axis=0)  # equal starts: one of two stays empty
    for seed in range(4):
        df = frame(spark, list(x))
        want, rounds, converged = plain(df, 4, seed, max_iterations=8)
        res = K.kmeans_train(df, 4, max_iterations=8, seed=seed)
        assert (res.iterations, res.converged) == (rounds, converged)
        assert np.allclose(trained(res), want, rtol=0, atol=1e-12)


def test_rounds_are_limited(spark):
    df = frame(spark, list(np.random.default_rng(8).normal(size=(200, 4))))
    res = K.kmeans_train(df, 5, max_iterations=2)
    assert (res.iterations, res.converged) == (2, False)
    assert np.allclose(trained(res), plain(df, 5, 42, 2)[0], rtol=0, atol=1e-12)


def test_later_rounds_skip_settled_vectors(spark, monkeypatch):
    seen, totals = [], K.Bounds._totals

    def watched(self, state, mat, bound, recent):
        out = totals(self, state, mat, bound, recent)
        seen.append((bound is None, state.count(), out[2]))
        return out

    monkeypatch.setattr(K.Bounds, "_totals", watched)
    df = frame(spark, list(np.vstack([blobs(500, 5, 6, 9, 0.05), blobs(100, 2, 6, 10, 1.0)])))
    res = K.kmeans_train(df, 7, seed=3)
    assert np.allclose(trained(res), plain(df, 7, 3)[0], rtol=0, atol=1e-12)
    changes = [(read, scored) for anchor, read, scored in seen if not anchor]
    assert min(read for read, _ in changes) < 200 and all(scored <= read for read, scored in changes)


def test_filter_on_the_gap_reaches_the_scan(spark):
    b = K.Bounds(frame(spark, list(blobs(50, 3, 4, 1))), np.arange(3), 4, 50, "embedding", 1 << 20)
    b.step(blobs(3, 3, 4, 2))
    plan = b.state.where(F.col("gap") <= 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(gap), LessThanOrEqual(gap,0.5)]" in plan


@pytest.mark.parametrize("budget", [64, 1 << 12], ids=["blocks of centroids", "totals through the shuffle"])
def test_small_budgets(spark, budget):
    df = frame(spark, list(blobs(150, 4, 6, 11)), parts=6)
    got = K.kmeans_train(df, 4, broadcast_bytes=budget)
    want, rounds, converged = plain(df, 4, 42)
    assert (got.iterations, got.converged) == (rounds, converged)
    assert np.allclose(trained(got), want, rtol=0, atol=1e-9)
