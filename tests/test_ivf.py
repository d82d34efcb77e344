"""k-means and IVF index: ports of the reference's tests plus invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiver.operators import ivf as I
from quiver.operators.kmeans import kmeans_train
from quiver.operators.knn import exact_knn_join
from quiver.session import scratch_path


def frame(spark, n, d, seed, start=0):
    rng = np.random.default_rng(seed)
    x = rng.uniform(-1, 1, size=(n, d)).astype(np.float32)
    rows = [(start + i, [float(v) for v in x[i]], {"id": str(start + i)}) for i in range(n)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, metadata map<string,string>"), x


def test_kmeans_training(spark):
    df, _ = frame(spark, 100, 10, 11)
    res = kmeans_train(df, 5, max_iterations=50)
    rows = res.centroids.collect()
    assert len(rows) == 5
    for r in rows:
        assert len(r.centroid) == 10
        assert np.linalg.norm(r.centroid) > 0.001
    assert 1 <= res.iterations <= 50


def test_kmeans_errors(spark):
    df, _ = frame(spark, 3, 4, 1)
    with pytest.raises(ValueError, match=">= nlist"):
        kmeans_train(df, 5)
    with pytest.raises(ValueError, match="empty"):
        kmeans_train(df.limit(0), 2)


@pytest.fixture(scope="module")
def trained(spark):
    train, _ = frame(spark, 500, 128, 21)
    idx = I.ivf_train(train, nlist=10, metric="l2")
    add, x = frame(spark, 100, 128, 22, start=1000)
    lists = I.ivf_add(idx, add, keep_cols=["metadata"]).cache()
    return idx, lists, add, x


def test_train_and_add(trained):
    idx, lists, _, _ = trained
    assert idx.trained and idx.nlist == 10
    assert I.ivf_size(lists) == 100


def test_search_top_is_self(trained):
    idx, lists, _, x = trained
    hits = I.ivf_search(idx, lists, [float(v) for v in x[0]], k=5, nprobe=3).collect()
    assert 1 <= len(hits) <= 5
    assert hits[0].doc_id == 1000 and hits[0].score < 0.001


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_search_each_metric(spark, metric):
    train, _ = frame(spark, 200, 32, 31)
    idx = I.ivf_train(train, nlist=10, metric=metric)
    add, x = frame(spark, 50, 32, 32)
    lists = I.ivf_add(idx, add)
    hits = I.ivf_search(idx, lists, [float(v) for v in x[0]], k=10, nprobe=3).collect()
    assert len(hits) >= 1 and hits[0].doc_id == 0


def test_every_vector_in_exactly_one_list(trained):
    idx, lists, add, _ = trained
    assert lists.groupBy("doc_id").count().where("count <> 1").count() == 0
    sizes = I.ivf_list_sizes(idx, lists).collect()
    assert len(sizes) == idx.nlist and sum(r.n for r in sizes) == add.count()


def test_full_probe_equals_exact(trained):
    idx, lists, add, _ = trained
    q = add.where("vec_id < 1010").select(F.col("vec_id").alias("query_id"), "embedding")
    approx = I.ivf_search_batch(idx, lists, q, k=5, nprobe=idx.nlist).collect()
    exact = exact_knn_join(add, q, 5, "l2").collect()
    a = sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in approx)
    e = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in exact)
    assert a == e


def test_recall_non_decreasing_in_nprobe(trained):
    idx, lists, add, _ = trained
    q = add.where("vec_id < 1020").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = exact_knn_join(add, q, 5, "l2")
    rec = []
    for p in (1, 2, 4, 10):
        r = I.recall_at_k(I.ivf_search_batch(idx, lists, q, k=5, nprobe=p), exact, 5).agg(F.avg("recall")).first()[0]
        rec.append(r)
    assert rec == sorted(rec) and rec[-1] == 1.0


def test_batch_equals_single(trained):
    idx, lists, add, x = trained
    q = add.where("vec_id = 1003").select(F.col("vec_id").alias("query_id"), "embedding")
    b = [(r["rank"], r.doc_id, r.score) for r in I.ivf_search_batch(idx, lists, q, k=5, nprobe=3).orderBy("rank").collect()]
    s = [(r["rank"], r.doc_id, r.score) for r in I.ivf_search(idx, lists, [float(v) for v in x[3]], k=5, nprobe=3).collect()]
    assert b == s


def test_edge_parameters(trained):
    idx, lists, _, x = trained
    q = [float(v) for v in x[0]]
    assert I.ivf_search(idx, lists, q, k=0, nprobe=3).count() == 0
    assert I.ivf_search(idx, lists, q, k=5, nprobe=0).count() == 0
    assert I.ivf_search(idx, lists, q, k=5, nprobe=1000).count() == 5   # nprobe clamped to nlist
    with pytest.raises(ValueError):
        I.ivf_search(idx, lists, q, k=-1, nprobe=3)
    with pytest.raises(ValueError):
        I.probe_one(idx, q[:10], 3)


def test_untrained_raises(spark):
    idx = I.IVFIndex(None, 10, 8, "l2", trained=False)
    with pytest.raises(RuntimeError, match="trained"):
        idx.require_trained()


def test_persistence(spark):
    train, _ = frame(spark, 300, 64, 41)
    idx = I.ivf_train(train, nlist=10)
    add, x = frame(spark, 50, 64, 42)
    lists = I.ivf_add(idx, add)
    path = scratch_path(spark, "test-ivf")
    I.ivf_save(idx, lists, path)
    idx2, lists2 = I.ivf_load(spark, path)
    assert idx2.trained and idx2.nlist == 10 and idx2.dimension == 64 and lists2.count() == 50
    hits = I.ivf_search(idx2, lists2, [float(v) for v in x[0]], k=3, nprobe=3).collect()
    assert hits[0].doc_id == 0
    # the probe filter reaches the scan as a partition filter
    plan = lists2.where(F.col("cluster_id").isin([1, 2]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "cluster_id" in plan


def test_stats(trained):
    idx, lists, _, _ = trained
    s = I.ivf_stats(idx, lists).first()
    assert s.nlist == 10 and s.dimension == 128 and s.metric_type == "l2" and s.is_trained
    assert s.total_vectors == 100 and s.min_cluster_size <= s.max_cluster_size
    assert abs(s.avg_cluster_size - 10.0) < 1e-9


def test_stream_ingest_then_compact(spark):
    from quiver.streaming import ingest
    from quiver.streaming.sources import stage_files

    train, _ = frame(spark, 200, 16, 51)
    idx = I.ivf_train(train, nlist=4)
    add, _ = frame(spark, 60, 16, 52)
    add = add.select("vec_id", "embedding")
    base = scratch_path(spark, "test-ingest")
    stage_files(add, f"{base}/in", F.col("vec_id") % 3, [0, 1, 2])
    q = ingest.ivf_ingest_stream(idx, ingest.read_stream(spark, f"{base}/in", add.schema), f"{base}/lists", f"{base}/ckpt")
    q.awaitTermination()
    lists = spark.read.parquet(f"{base}/lists")
    assert lists.count() == 60 and lists.select("batch_id").distinct().count() >= 3
    compact = I.compact_lists(spark, f"{base}/lists", f"{base}/compact")
    assert compact.count() == 60 and "batch_id" not in compact.columns
    batch = I.ivf_add(idx, add).select("doc_id", "cluster_id")
    assert sorted(compact.select("doc_id", "cluster_id").collect()) == sorted(batch.collect())


def test_batch_search_returns_metadata(trained):
    idx, lists, add, _ = trained
    q = add.where("vec_id in (1001, 1002)").select(F.col("vec_id").alias("query_id"), "embedding")
    hits = I.ivf_search_batch(idx, lists, q, k=3, nprobe=2, extra_cols=["metadata"]).collect()
    assert len(hits) == 6
    assert all(h.metadata["id"] == str(h.doc_id) for h in hits)


def test_list_skew_flags_unbalanced_lists(trained, spark):
    idx, lists, _, _ = trained
    ok = I.list_skew(idx, lists, max_ratio=1000.0).first()
    assert ok.needs_retrain is False and ok.skew_ratio >= 1.0
    one = lists.withColumn("cluster_id", F.lit(0).cast("long"))      # everything in one list
    bad = I.list_skew(idx, one, max_ratio=4.0).first()
    assert bad.needs_retrain is True and abs(bad.skew_ratio - 10.0) < 1e-9
