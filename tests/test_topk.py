"""Batch search: both routes against brute force, and what its plans hold."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from quiver.operators import ivf as I
from quiver.operators import topk
from quiver.operators.knn import exact_knn_join

D = 6


def vectors(n, seed, repeats=3):
    """Small whole numbers, so that scores tie often."""
    return np.random.default_rng(seed).integers(-repeats, repeats + 1, (n, D)).astype(float)


def frame(spark, ids, x, extra=False):
    rows = [(i, [float(c) for c in v] if v is not None else None, f"row-{j}") for j, (i, v) in enumerate(zip(ids, x))]
    kind = "string" if any(isinstance(i, str) for i in ids) else "long"
    df = spark.createDataFrame(rows, f"vec_id {kind}, embedding array<double>, tag string")
    return df if extra else df.drop("tag")


def brute(ids, x, query_ids, q, k, metric, allowed=None):
    out = []
    for j, qi in enumerate(query_ids):
        scored = []
        for n, (i, v) in enumerate(zip(ids, x)):
            if v is None or q[j] is None or allowed is not None and not allowed(j, n):
                continue
            s = float(np.dot(v, q[j]))
            if metric == "l2":
                s = float(np.sqrt(sum((a - b) ** 2 for a, b in zip(v, q[j]))))
            if metric == "cosine":
                size = np.sqrt(sum(a * a for a in v)) * np.sqrt(sum(b * b for b in q[j]))
                s = s / size if size else 0.0
            scored.append((round(s, 9) if metric == "l2" else -round(s, 9), i))
        out += [(qi, r + 1, i, round(abs(s) if metric == "l2" else -s, 6) + 0.0) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def rows(df, id_col="vec_id"):
    return sorted(((r.query_id, r["rank"], r[id_col], r.score + 0.0) for r in df.collect()), key=str)


@pytest.mark.parametrize("budget", [1 << 26, 700], ids=["in place", "grid"])
@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_exact_join(spark, metric, budget):
    ids, x = list(range(150)), [*vectors(148, 1), None, np.zeros(D)]
    query_ids, q = [7, 3, 900, 901, 902], [*vectors(3, 2), None, np.zeros(D)]
    corpus, queries = frame(spark, ids, x).repartition(5), frame(spark, query_ids, q).withColumnRenamed("vec_id", "query_id")
    got = exact_knn_join(corpus, queries, 4, metric, broadcast_bytes=budget)
    assert rows(got) == brute(ids, x, query_ids, q, 4, metric)


@pytest.mark.parametrize("budget", [1 << 26, 700], ids=["in place", "grid"])
def test_text_ids_repeated_rows_and_kept_columns(spark, budget):
    ids = [f"v{'x' * (i % 7)}{i}" for i in range(90)] + ["v0", "v0"]
    x = [*vectors(90, 3), np.ones(D), np.ones(D)]
    query_ids, q = ["b", "a" * 30, "c"], list(vectors(3, 4))
    corpus = frame(spark, ids, x, extra=True).repartition(7)
    queries = frame(spark, query_ids, q).withColumnRenamed("vec_id", "query_id").repartition(3)
    got = topk.block_topk(corpus, queries, 5, "l2", broadcast_bytes=budget, keep_cols=["tag"], cell_rows=20).collect()
    want = brute(ids, x, query_ids, q, 5, "l2")
    assert sorted(((r.query_id, r["rank"], r.vec_id, round(r.raw, 6) + 0.0) for r in got), key=str) == want
    for r in got:  # the kept column is that of a row with this id and this very score
        j, i = query_ids.index(r.query_id), int(r.tag[4:])
        assert ids[i] == r.vec_id and abs(np.sqrt(((x[i] - q[j]) ** 2).sum()) - r.raw) < 1e-12
    with pytest.raises(ValueError):
        topk.block_topk(corpus.withColumnRenamed("tag", "rank"), queries, 5, "l2", keep_cols=["rank"])


@pytest.mark.parametrize("budget", [1 << 26, 900], ids=["in place", "grid"])
@pytest.mark.parametrize("nprobe", [1, 3])
def test_ivf_search_with_a_hot_list(spark, budget, nprobe):
    """Nine rows in ten, and most queries, belong to one list."""
    cent = np.vstack([np.zeros(D), 50 + vectors(4, 5)])
    ids, x = list(range(200)), np.vstack([vectors(180, 6), 50 + vectors(20, 7)])
    query_ids, q = list(range(1000, 1020)), np.vstack([vectors(17, 8), 50 + vectors(3, 9)])
    near = lambda v: np.argsort([((v - c) ** 2).sum() for c in cent], kind="stable")
    index = I.from_centroids(spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(cent)], "vec_id long, embedding array<double>"),
                             "l2", "vec_id", "embedding")
    lists = I.ivf_add(index, frame(spark, ids, x)).repartition(4)
    own = [int(near(v)[0]) for v in x]
    queries = frame(spark, query_ids, q).withColumnRenamed("vec_id", "query_id")
    got = I.ivf_search_batch(index, lists, queries, k=3, nprobe=nprobe, broadcast_bytes=budget)
    want = brute(ids, list(x), query_ids, list(q), 3, "l2", lambda j, n: own[n] in near(q[j])[:nprobe])
    assert rows(got, "doc_id") == want
    assert I.ivf_search_batch(index, lists, queries, k=3, nprobe=0, broadcast_bytes=budget).count() == 0


@pytest.mark.parametrize("budget", [1 << 26, 1], ids=["in place", "grid"])
def test_empty_sides(spark, budget):
    some, none = frame(spark, [1, 2], vectors(2, 1)), frame(spark, [1], vectors(1, 1)).limit(0)
    ask = lambda df: df.withColumnRenamed("vec_id", "query_id")
    for corpus, queries in ((some, ask(none)), (none, ask(some)), (none, ask(none))):
        assert exact_knn_join(corpus, queries, 2, "l2", broadcast_bytes=budget).count() == 0
    assert exact_knn_join(some, ask(some), 0, "l2", broadcast_bytes=budget).count() == 0


def test_queries_are_not_collected(spark, monkeypatch):
    corpus, queries = frame(spark, list(range(50)), vectors(50, 1)), frame(spark, [1, 2, 3], vectors(3, 2)).withColumnRenamed("vec_id", "query_id")

    def refused(*_):
        raise AssertionError("collected while the plan was built")

    for budget in (1 << 26, 1):
        with monkeypatch.context() as m:
            m.setattr(DataFrame, "toArrow", refused)
            m.setattr(DataFrame, "toPandas", refused)
            got = topk.block_topk(corpus, queries, 2, "l2", broadcast_bytes=budget)
        assert got.count() == 6
    plan = topk.block_topk(corpus, queries, 2, "l2")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_many_blocks_of_queries_before_the_rows():
    """The head row comes once a block; slabs may end among the copies."""
    def block(i):
        sink = pa.BufferOutputStream()
        batch = pa.RecordBatch.from_arrays([pa.array([i])], names=["query_id"])
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        return sink.getvalue().to_pybytes()

    ids = [5, 5, 5, 5, 6, 7, 8]
    blocks = [block(0), block(1), block(2), block(3), None, None, None]
    for cut in range(1, 8):
        batches = [pa.RecordBatch.from_arrays([pa.array(ids[a:b], pa.int64()), pa.array(blocks[a:b], pa.binary())], names=["_id", "queries"])
                   for a, b in ((0, cut), (cut, 7)) if a < b]
        for rows_of_slab in (1, 100):
            slabs = topk.slabs
            try:
                topk.slabs = lambda b, n=rows_of_slab: slabs(b, n)
                table, *parts = topk._after_heads(iter(batches))
            finally:
                topk.slabs = slabs
            assert table.column("query_id").to_pylist() == [0, 1, 2, 3]
            assert [i for p in parts for i in p.column("_id").to_pylist()] == [5, 6, 7, 8]


def test_best_keeps_ties_by_id():
    best = topk.Best(2, 2, True)
    best.add(np.array([1]), np.array([[1.0, 1.0]]), np.array([[9, 4]]), np.array([[0, 1]]))
    best.add(np.array([0, 1]), np.array([[np.nan], [1.0]]), np.array([[0], [2]]), np.array([[-1], [2]]))
    assert best.ids[1].tolist() == [2, 4] and best.row[0].tolist() == [-1, -1]


def test_equal_vectors_are_scored_in_bounded_memory():
    """Ties make every (row, column) pair a candidate: the pairs are gathered a bounded number at a time."""
    import tracemalloc

    from quiver.operators.block import topk_exact

    rows, cols = np.ones((64, 64)), np.ones((1 << 14, 64))
    ids = np.arange(len(cols))[::-1].copy()
    for metric, score in (("l2", 0.0), ("cosine", 1.0), ("dot", 64.0)):
        tracemalloc.start()
        place, raw = topk_exact(rows, cols, ids, metric, 3)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 150 << 20
        assert (ids[place] == [0, 1, 2]).all() and (raw == score).all()
