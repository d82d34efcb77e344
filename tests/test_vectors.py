"""Vector similarity, exact search and the block scorer (ports of the reference's unit tests + invariants)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiver.functions.vector import cosine_similarity, dot_product, l2_distance, normalize_metric
from quiver.operators.block import score_matrix
from quiver.operators.knn import exact_knn, exact_knn_join, score_all


def pair(spark, a, b):
    return spark.createDataFrame([(a, b)], "a array<float>, b array<float>")


def test_l2_self_zero_positive_symmetric(spark):
    df = pair(spark, [1.0, 2.0, 3.0], [4.0, 5.0, 6.0])
    r = df.select(l2_distance("a", "a").alias("s"), l2_distance("a", "b").alias("ab"), l2_distance("b", "a").alias("ba")).first()
    assert r.s == 0.0
    assert r.ab > 0 and abs(r.ab - r.ba) < 1e-4
    assert abs(r.ab - math.sqrt(27)) < 1e-9


def test_cosine_self_orthogonal_zero_norm(spark):
    df = pair(spark, [1.0, 0.0, 0.0], [0.0, 1.0, 0.0])
    r = df.select(cosine_similarity("a", "a").alias("s"), cosine_similarity("a", "b").alias("o"),
                  cosine_similarity("b", "a").alias("o2"),
                  cosine_similarity("a", F.array(*[F.lit(0.0)] * 3)).alias("z")).first()
    assert abs(r.s - 1.0) < 1e-9 and abs(r.o) < 1e-9 and abs(r.o - r.o2) < 1e-9
    assert r.z == 0.0


def test_dot_product(spark):
    r = pair(spark, [1.0, 2.0, 3.0], [4.0, 5.0, 6.0]).select(dot_product("a", "b").alias("d"), dot_product("b", "a").alias("e")).first()
    assert r.d == 32.0 and r.e == 32.0


def test_dimension_mismatch_raises(spark):
    df = pair(spark, [1.0, 2.0, 3.0], [1.0, 2.0])
    with pytest.raises(Exception, match="same dimension"):
        df.select(l2_distance("a", "b")).collect()


def test_metric_aliases():
    assert normalize_metric("l2_norm") == "l2" and normalize_metric("dot_product") == "dot"
    with pytest.raises(ValueError):
        normalize_metric("hamming")


def _random(spark, n, d, seed):
    rng = np.random.default_rng(seed)
    x = rng.uniform(-1, 1, size=(n, d)).astype(np.float32)
    return spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(n)], "vec_id long, embedding array<float>"), x


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_block_scorer_matches_expression(spark, metric):
    df, x = _random(spark, 60, 16, 1)
    q = [float(v) for v in x[7]]
    expr = {r.vec_id: r.score for r in score_all(df, q, metric, raw=True).collect()}
    blk = score_matrix(x.astype(np.float64), np.asarray([q]), metric)[:, 0]
    for i in range(60):
        assert expr[i] == blk[i], (i, expr[i], blk[i])   # bit-identical, same summation order


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_knn_join_equals_single_query_knn(spark, metric):
    df, x = _random(spark, 200, 8, 2)
    queries = df.where("vec_id in (3, 50, 199)").select(F.col("vec_id").alias("query_id"), "embedding")
    joined = exact_knn_join(df.repartition(5), queries, 7, metric).collect()
    for qid in (3, 50, 199):
        single = exact_knn(df, [float(v) for v in x[qid]], 7, metric).collect()
        mine = sorted((r["rank"], r.vec_id, r.score) for r in joined if r.query_id == qid)
        assert mine == [(r["rank"], r.vec_id, r.score) for r in single]


def test_knn_k_larger_than_n_and_zero(spark):
    df, x = _random(spark, 5, 4, 3)
    assert exact_knn(df, [0.0] * 4, 10, "l2").count() == 5
    assert exact_knn(df, [0.0] * 4, 0, "l2").count() == 0


def test_ties_go_to_lowest_id(spark):
    df = spark.createDataFrame([(i, [1.0, 1.0]) for i in (9, 4, 6)] + [(1, [5.0, 5.0])], "vec_id long, embedding array<float>")
    top = exact_knn(df, [1.0, 1.0], 2, "l2").collect()
    assert [r.vec_id for r in top] == [4, 6]
    q = df.where("vec_id = 1").select(F.col("vec_id").alias("query_id"), "embedding")
    j = exact_knn_join(df, q, 2, "cosine").orderBy("rank").collect()
    assert [r.vec_id for r in j] == [1, 4]


def test_knn_join_chunks_queries_beyond_budget(spark):
    df, x = _random(spark, 100, 8, 4)
    queries = df.select(F.col("vec_id").alias("query_id"), "embedding")
    full = exact_knn_join(df, queries, 3, "l2").collect()
    tiny = exact_knn_join(df, queries, 3, "l2", broadcast_bytes=8 * 8 * 10).collect()   # ~10 queries per block
    key = lambda r: (r.query_id, r["rank"])
    assert sorted(full, key=key) == sorted(tiny, key=key)
    assert all(r.vec_id == r.query_id for r in full if r["rank"] == 1)


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
@pytest.mark.parametrize("seed", [0, 1, 2])
def test_screened_topk_equals_brute_force(metric, seed):
    from quiver.operators.block import _sort_key, topk_exact

    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(300, 24)).astype(np.float32).astype(np.float64)
    cols = rng.normal(size=(180, 24)).astype(np.float32).astype(np.float64) * rng.uniform(0.1, 10, size=(180, 1))
    cols[10] = cols[3]                      # exact duplicates -> ties broken by id
    cols[50] = 0.0                          # zero vector (cosine = 0)
    rows[7] = cols[3]                       # a row equal to a column (distance 0)
    ids = rng.permutation(1000)[:180]
    pos, raw = topk_exact(rows, cols, ids, metric, 7)
    full = score_matrix(rows, cols, metric)
    for i in range(rows.shape[0]):
        key = _sort_key(full[i], metric == "l2")
        order = np.lexsort((ids, key))[:7]
        assert list(pos[i]) == list(order)
        assert np.array_equal(raw[i], full[i][order])


def test_nearest_centers_blocked_equals_single_block(spark):
    from quiver.operators.block import nearest_centers

    df, x = _random(spark, 120, 8, 9)
    centers = df.where("vec_id < 40").select(F.col("vec_id").alias("cluster_id"), F.col("embedding").cast("array<double>").alias("centroid"))
    one = nearest_centers(df, centers, 3, "l2").collect()
    many = nearest_centers(df, centers, 3, "l2", broadcast_bytes=8 * 8 * 7).collect()   # ~7 centers per block
    key = lambda r: (r.vec_id, r["rank"])
    assert [(r.vec_id, r["rank"], r.cluster_id, r.raw) for r in sorted(one, key=key)] == \
        [(r.vec_id, r["rank"], r.cluster_id, r.raw) for r in sorted(many, key=key)]


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_single_query_block_mode_equals_expr(spark, metric):
    df, x = _random(spark, 150, 12, 5)
    q = [float(v) for v in x[11]]
    a = [tuple(r) for r in exact_knn(df, q, 9, metric).collect()]
    b = sorted(tuple(r) for r in exact_knn(df.repartition(3), q, 9, metric, mode="block").collect())
    assert sorted(a) == b


def test_screened_topk_small_row_chunks(monkeypatch):
    import quiver.operators.block as B

    rng = np.random.default_rng(7)
    rows, cols = rng.normal(size=(50, 6)), rng.normal(size=(30, 6))
    ids = np.arange(30)
    full = B.topk_exact(rows, cols, ids, "l2", 4)
    monkeypatch.setattr(B, "SCREEN_CELLS", 60)          # two rows per chunk
    part = B.topk_exact(rows, cols, ids, "l2", 4)
    assert np.array_equal(full[0], part[0]) and np.array_equal(full[1], part[1])


def test_both_modes_agree_with_null_vectors(spark):
    import quiver.operators.knn as K

    df, x = _random(spark, 80, 6, 8)
    df = df.unionByName(spark.createDataFrame([(-1, None)], df.schema))
    q = [float(v) for v in x[5]]
    expr = K.exact_knn(df, q, 4, "l2").collect()
    block = K.exact_knn(df, q, 4, "l2", mode="block").collect()
    assert sorted(tuple(r) for r in expr) == sorted(tuple(r) for r in block)
    assert all(r["vec_id"] >= 0 for r in expr)
    with pytest.raises(ValueError):
        K.exact_knn(df, q, 4, "l2", mode="block", extra_cols=["embedding"])


def test_blocked_centers_keep_rows_that_share_an_id(spark):
    import quiver.operators.block as B

    rows = [(7, [0.0, 1.0], "a"), (7, [5.0, 5.0], "b"), (8, [5.0, 6.0], "c"), (9, None, "d")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, note string")
    centers = spark.createDataFrame([(k, [float(k), float(k)]) for k in range(6)], "cluster_id long, centroid array<double>")
    whole = B.nearest_centers(df, centers, 2, "l2", keep_cols=["note"])
    parts = B.nearest_centers(df, centers, 2, "l2", keep_cols=["note"], broadcast_bytes=40)
    cols = ["vec_id", "note", "rank", "cluster_id", "raw"]
    assert sorted(tuple(r[c] for c in cols) for r in whole.collect()) == sorted(tuple(r[c] for c in cols) for r in parts.collect())
    assert whole.count() == 6
