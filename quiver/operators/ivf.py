"""Inverted-file (IVF) index over DataFrames: I1-I16.

Layout on disk: ``<path>/centroids`` (cluster_id, centroid),
``<path>/params`` (one row) and ``<path>/lists`` partitioned by
``cluster_id``, so probing nprobe of nlist lists is a partition filter.

* assignment / probing: narrow map with the centroid table broadcast
  (``nearest_centers``), by the **index metric** (k-means itself uses L2).
* one query: probes are picked on the driver from the small centroid table,
  then ``cluster_id IN (...)`` prunes the scan and a literal-vector score
  expression feeds ``TakeOrderedAndProject``.
* many queries: every query row gets its probes beside it (``probed``), and
  ``quiver.operators.topk`` brings queries and lists together - by broadcast
  while the queries fit, else in cells of (list, query slice, list slice), so
  that neither a hot list nor a popular one gathers in a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quiver.functions.vector import ascending, metric_score, normalize_metric, order_columns, round_score
from quiver.operators.block import (
    DEFAULT_BROADCAST_BYTES,
    _sort_key,
    arrow_vectors,
    best_k,
    check_block_size,
    _nearest_arrays,
    collect_block,
    nearest_centers,
    score_matrix,
    topk_exact,
)
from quiver.operators.topk import block_topk
from quiver.operators.kmeans import SEED, centroid_frame, kmeans_train
from quiver.session import ship_package

# ANN query and mapping defaults.
DEFAULT_NLIST = 100
DEFAULT_NPROBE = 10
DEFAULT_K = 10
DEFAULT_ALGORITHM = "ivf"
#: Column metadata of lists that stand in a folder each.
FOLDERS = "folder_per_value"


@dataclass
class IVFIndex:
    centroids: DataFrame          # cluster_id long, centroid array<double>
    nlist: int
    dimension: int
    metric: str
    trained: bool = True
    lists: DataFrame | None = None  # cluster_id long, doc_id long, vector array<double>, ...

    def require_trained(self):
        if not self.trained or self.centroids is None:
            raise RuntimeError("Index must be trained before searching")

    def centroid_arrays(self):
        """(ids, matrix) of the centroids, collected once (nlist x d, size-checked)."""
        if getattr(self, "_arrays", None) is None:
            if check_block_size(self.nlist, self.dimension, DEFAULT_BROADCAST_BYTES) > 1:
                return None
            self._arrays = collect_block(self.centroids, "cluster_id", "centroid")
        return self._arrays

    def nearest(self, df: DataFrame, k: int, id_col: str, vec_col: str, keep_cols=None) -> DataFrame:
        """Best k lists per row by the index metric (cached centroids when they fit a broadcast)."""
        arr = self.centroid_arrays()
        if arr is None:
            return nearest_centers(df, self.centroids, k, self.metric, id_col=id_col, vec_col=vec_col,
                                   keep_cols=keep_cols)
        return _nearest_arrays(df, arr[0], arr[1], max(0, min(k, len(arr[0]))), self.metric, id_col, vec_col,
                               "cluster_id", keep_cols)


def from_centroids(centroids: DataFrame, metric: str, id_col: str = "cluster_id",
                   vec_col: str = "centroid") -> IVFIndex:
    c = centroids.select(F.col(id_col).cast("long").alias("cluster_id"),
                         F.col(vec_col).cast("array<double>").alias("centroid"))
    stats = c.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("centroid")).alias("d")).first()
    return IVFIndex(c, int(stats["n"]), int(stats["d"] or 0), normalize_metric(metric))


def ivf_train(df: DataFrame, nlist: int = DEFAULT_NLIST, metric: str = "l2", id_col: str = "vec_id",
              vec_col: str = "embedding", max_iterations: int = 100, seed: int = SEED) -> IVFIndex:
    """Train the coarse quantiser with k-means (L2)."""
    metric = normalize_metric(metric)
    res = kmeans_train(df, nlist, max_iterations=max_iterations, seed=seed, id_col=id_col, vec_col=vec_col)
    dim = len(res.centroids.select("centroid").first()[0])
    return IVFIndex(res.centroids, nlist, dim, metric)


def ivf_add(index: IVFIndex, df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
            keep_cols: list[str] | None = None, dedupe_order: str | None = None) -> DataFrame:
    """Assign every row to its best list by the index metric.

    Returns ``(cluster_id, doc_id, vector, *keep_cols)``; with
    ``dedupe_order`` the latest row per id wins instead of duplicating.
    """
    index.require_trained()
    keep = list(keep_cols or [])
    src = df
    if dedupe_order:
        from quiver.operators.tenants import latest_per_key

        src = latest_per_key(src, [id_col], [dedupe_order])
    src = src.select(F.col(id_col), F.col(vec_col).cast("array<double>").alias(vec_col), *keep)
    missing = F.col(vec_col).isNull()
    src = src.withColumn(vec_col, F.when(missing, F.raise_error(F.lit("Vector is null: filter with vector_validate"))).otherwise(F.col(vec_col)))
    bad = F.size(vec_col) != F.lit(index.dimension)
    src = src.withColumn(vec_col, F.when(bad, F.raise_error(F.concat(
        F.lit(f"Vector dimension mismatch: expected {index.dimension}, got "), F.size(vec_col).cast("string")))
    ).otherwise(F.col(vec_col)))
    out = index.nearest(src, 1, id_col, vec_col, keep_cols=[vec_col] + keep)
    return out.select("cluster_id", F.col(id_col).alias("doc_id"), F.col(vec_col).alias("vector"), *keep)


def ivf_probe(index: IVFIndex, queries: DataFrame, nprobe: int, query_id_col: str = "query_id",
              vec_col: str = "embedding") -> DataFrame:
    """I4 (batch): best min(nprobe, nlist) lists per query: ``(query_id, rank, cluster_id, score)``."""
    index.require_trained()
    if nprobe < 0:
        raise ValueError("nprobe must be >= 0")
    out = index.nearest(queries, min(nprobe, index.nlist), query_id_col, vec_col)
    return out.select(F.col(query_id_col).alias("query_id"), "rank", "cluster_id",
                      round_score(F.col("raw")).alias("score"))


def probed(index: IVFIndex, queries: DataFrame, nprobe: int, query_id_col: str = "query_id", vec_col: str = "embedding") -> DataFrame:
    """``(query_id, qv, probes)``: every query row with a vector, beside the ids of its best lists."""
    index.require_trained()
    if nprobe < 0:
        raise ValueError("nprobe must be >= 0")
    q = queries.select(F.col(query_id_col).alias("query_id"), F.col(vec_col).cast("array<double>").alias("qv")).where("qv is not null")
    k, arrays = min(nprobe, index.nlist), index.centroid_arrays()
    if arrays is None:
        near = nearest_centers(q, index.centroids, k, index.metric, id_col="query_id", vec_col="qv", keep_cols=["qv"])
        return near.groupBy("query_id", "qv").agg(F.collect_set("cluster_id").alias("probes"))
    ship_package(q.sparkSession)
    centers = q.sparkSession.sparkContext.broadcast(arrays)
    metric = index.metric

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, mat = centers.value
        for batch in batches:
            place, _ = topk_exact(arrow_vectors(batch.column("qv"), mat.shape[1]), mat, ids, metric, k)
            found = pa.ListArray.from_arrays(pa.array(np.arange(len(place) + 1) * place.shape[1], pa.int32()), pa.array(ids[place].reshape(-1), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("qv"), found], names=["query_id", "qv", "probes"])

    return q.mapInArrow(run, f"query_id {q.schema['query_id'].dataType.simpleString()}, qv array<double>, probes array<long>")


def probe_one(index: IVFIndex, vector, nprobe: int) -> list[int]:
    """I4 (single query) on the driver: the centroid table is nlist x d."""
    index.require_trained()
    if nprobe < 0:
        raise ValueError("nprobe must be >= 0")
    q = np.asarray(vector, dtype=np.float64)[None, :]
    if q.shape[1] != index.dimension:
        raise ValueError("Query vector dimension mismatch")
    arr = index.centroid_arrays()
    if arr is None:  # ranked by a job: only the nprobe best ids come back
        one = index.centroids.sparkSession.createDataFrame([(0, [float(v) for v in q[0]])], "query_id long, qv array<double>")
        best = nearest_centers(one, index.centroids, min(nprobe, index.nlist), index.metric, id_col="query_id", vec_col="qv")
        return [int(r["cluster_id"]) for r in best.orderBy("rank").collect()]
    ids, mat = arr
    sc = score_matrix(mat, q, index.metric)[:, 0]
    pos = best_k(_sort_key(sc, ascending(index.metric)), ids, min(nprobe, index.nlist))
    return [int(ids[p]) for p in pos]


def ivf_search(index: IVFIndex, lists: DataFrame, vector, k: int = DEFAULT_K, nprobe: int = DEFAULT_NPROBE,
               extra_cols: list[str] | None = None) -> DataFrame:
    """``(rank, doc_id, score, *extra_cols)`` for one query; empty if no candidate."""
    if k < 0:
        raise ValueError("k must be >= 0")
    probes = probe_one(index, vector, nprobe)
    extra = list(extra_cols or [])
    spark = lists.sparkSession
    if not probes or k == 0:
        schema = "rank int, doc_id long, score double"
        return spark.createDataFrame([], schema) if not extra else lists.select(
            F.lit(1).alias("rank"), "doc_id", F.lit(0.0).alias("score"), *extra).limit(0)
    from quiver.functions.vector import vector_literal

    cand = lists.where(F.col("cluster_id").isin(probes))
    scored = cand.select("doc_id", metric_score(index.metric, F.col("vector"), vector_literal(vector)).alias("raw"),
                         *extra)
    top = scored.orderBy(*order_columns(index.metric, "raw", "doc_id")).limit(k)
    w = Window.orderBy(*order_columns(index.metric, "raw", "doc_id"))
    return top.select(F.row_number().over(w).alias("rank"), "doc_id", round_score(F.col("raw")).alias("score"),
                      *extra)


def ivf_search_batch(index: IVFIndex, lists: DataFrame, queries: DataFrame, k: int = DEFAULT_K,
                     nprobe: int = DEFAULT_NPROBE, query_id_col: str = "query_id", vec_col: str = "embedding",
                     broadcast_bytes: int = DEFAULT_BROADCAST_BYTES, extra_cols: list[str] | None = None) -> DataFrame:
    """``(query_id, rank, doc_id, score, *extra_cols)`` for every query row.

    ``extra_cols`` (e.g. the metadata map) are carried with the rows that were hit,
    so an id that was added twice gives each hit its own values.
    """
    if k < 0:
        raise ValueError("k must be >= 0")
    asked = probed(index, queries, nprobe, query_id_col, vec_col)
    if lists.schema["cluster_id"].metadata.get(FOLDERS):
        # ids of lists, at most nlist: prunes the folders of a saved index
        wanted = [r[0] for r in asked.select(F.explode("probes")).distinct().limit(index.nlist).collect()]
        if len(wanted) < index.nlist:
            lists = lists.where(F.col("cluster_id").isin(wanted))
    size = queries.where(F.col(vec_col).isNotNull()).count(), index.dimension
    top = block_topk(lists, asked, k, index.metric, id_col="doc_id", vec_col="vector", query_vec_col="qv", probes_col="probes",
                     broadcast_bytes=broadcast_bytes, keep_cols=extra_cols, query_size=size)
    return top.select("query_id", "rank", "doc_id", round_score(F.col("raw")).alias("score"), *(extra_cols or []))


def ivf_list_sizes(index: IVFIndex, lists: DataFrame) -> DataFrame:
    """``(cluster_id, n)`` for every list, empty ones as 0."""
    counts = lists.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    return (index.centroids.select("cluster_id")
            .join(counts, "cluster_id", "left")
            .select("cluster_id", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")))


def ivf_size(lists: DataFrame) -> int:
    return lists.count()


def ivf_stats(index: IVFIndex, lists: DataFrame) -> DataFrame:
    """I8: one row; min/max/avg list size count empty lists, avg = total / nlist."""
    sizes = ivf_list_sizes(index, lists)
    agg = sizes.agg(F.sum("n").alias("total_vectors"), F.min("n").alias("min_cluster_size"),
                    F.max("n").alias("max_cluster_size"))
    return agg.select(
        F.lit(index.nlist).cast("long").alias("nlist"), F.lit(index.dimension).cast("long").alias("dimension"),
        F.lit(index.metric).alias("metric_type"), F.lit(index.trained).alias("is_trained"),
        F.col("total_vectors").cast("long").alias("total_vectors"),
        F.col("min_cluster_size").cast("long").alias("min_cluster_size"),
        F.col("max_cluster_size").cast("long").alias("max_cluster_size"),
        F.round(F.col("total_vectors") / F.lit(index.nlist), 6).alias("avg_cluster_size"),
    )


def list_skew(index: IVFIndex, lists: DataFrame, max_ratio: float = 4.0) -> DataFrame:
    """Largest list relative to the mean list size, and whether it calls for retraining
    (incremental adds drift away from the centroids the lists were trained with)."""
    st = ivf_stats(index, lists)
    ratio = F.try_divide(F.col("max_cluster_size").cast("double"), F.col("avg_cluster_size"))
    return st.select("total_vectors", "max_cluster_size", "avg_cluster_size", F.round(ratio, 6).alias("skew_ratio"),
                     F.coalesce(ratio > F.lit(max_ratio), F.lit(False)).alias("needs_retrain"))


def ivf_save(index: IVFIndex, lists: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Centroids, params and lists (partitioned by cluster_id) as Parquet."""
    spark = lists.sparkSession
    index.centroids.write.mode(mode).parquet(f"{path}/centroids")
    spark.createDataFrame([(index.nlist, index.dimension, index.metric, index.trained)],
                          "nlist int, dimension int, metric string, trained boolean") \
        .write.mode(mode).parquet(f"{path}/params")
    # REBALANCE on the list id: each list is written by few tasks, and AQE
    # splits a hot list over several tasks (several files in its folder).
    lists.hint("rebalance", "cluster_id").write.mode(mode).partitionBy("cluster_id").parquet(f"{path}/lists")


def compact_lists(spark: SparkSession, path: str, target: str) -> DataFrame:
    """Rewrite streamed lists (many small ``batch_id`` files per list) as one folder per list.

    Latest version per doc_id wins, so a re-sent vector replaces the old one.
    """
    lists = spark.read.parquet(path)
    if "batch_id" in lists.columns:
        from quiver.operators.tenants import latest_per_key

        lists = latest_per_key(lists, ["doc_id"], ["batch_id"]).drop("batch_id")
    lists.hint("rebalance", "cluster_id").write.mode("overwrite").partitionBy("cluster_id").parquet(target)
    return spark.read.parquet(target)


def ivf_load(spark: SparkSession, path: str) -> tuple[IVFIndex, DataFrame]:
    p = spark.read.parquet(f"{path}/params").first()
    cent = spark.read.parquet(f"{path}/centroids")
    lists = spark.read.parquet(f"{path}/lists").withMetadata("cluster_id", {FOLDERS: True})
    return IVFIndex(cent, int(p["nlist"]), int(p["dimension"]), p["metric"], bool(p["trained"])), lists


def ivf_clear(index: IVFIndex, lists: DataFrame, path: str) -> DataFrame:
    """Drop every vector, keep centroids and params; returns the empty lists."""
    ivf_save(index, lists.limit(0), path)
    return lists.sparkSession.read.schema(lists.schema).parquet(f"{path}/lists")


def ann(index: IVFIndex, lists: DataFrame, vector, field: str = "vector", algorithm: str = DEFAULT_ALGORITHM,
        nprobe: int = DEFAULT_NPROBE, k: int = DEFAULT_K, extra_cols: list[str] | None = None) -> DataFrame:
    """The ANN query with its defaults and validation."""
    if not field:
        raise ValueError("[ann] requires 'field'")
    if vector is None or len(vector) == 0:
        raise ValueError("[ann] requires 'vector'")
    if algorithm != DEFAULT_ALGORITHM:
        raise ValueError(f"[ann] unsupported algorithm '{algorithm}'")
    if nprobe < 0 or k < 0:
        raise ValueError("[ann] nprobe and k must be >= 0")
    return ivf_search(index, lists, vector, k=k, nprobe=nprobe, extra_cols=extra_cols)


def hits_to_docs(docs: DataFrame, hits: DataFrame, doc_key: str = "doc_id") -> DataFrame:
    """Documents restricted to the hits, keeping rank and score.

    No broadcast hint: k hits of one query are tiny and Spark's size estimate
    broadcasts them, while a large batch of hits falls back to a shuffle join.
    """
    return docs.join(hits, doc_key, "inner")


def train_job(df: DataFrame, table_name: str, column: str, nlist: int = DEFAULT_NLIST, metric: str = "l2",
              id_col: str = "vec_id") -> tuple[DataFrame, IVFIndex | None]:
    """Train from (table, column, nlist, metric); 1-row outcome table."""
    spark = df.sparkSession
    schema = "success boolean, message string, vector_count long, nlist long"
    if not table_name or not column:
        return spark.createDataFrame([(False, "index_name and field_name are required", 0, nlist)], schema), None
    try:
        index = ivf_train(df, nlist=nlist, metric=metric, id_col=id_col, vec_col=column)
        n = df.where(F.col(column).isNotNull()).count()
        msg = f"IVF index trained successfully with {nlist} clusters"
        return spark.createDataFrame([(True, msg, n, nlist)], schema), index
    except ValueError as ex:
        return spark.createDataFrame([(False, str(ex), 0, nlist)], schema), None


def recall_at_k(approx: DataFrame, exact: DataFrame, k: int, id_col: str = "doc_id",
                exact_id_col: str = "vec_id") -> DataFrame:
    """I16: ``(query_id, recall)`` = |approx top-k ∩ exact top-k| / k."""
    e = exact.select("query_id", F.col(exact_id_col).alias("_id"))
    a = approx.select("query_id", F.col(id_col).alias("_id"), F.lit(1).alias("_hit"))
    j = e.join(a, ["query_id", "_id"], "left")
    return j.groupBy("query_id").agg(
        F.round(F.sum(F.coalesce(F.col("_hit"), F.lit(0))) / F.lit(k), 6).alias("recall"))


__all__ = [
    "IVFIndex", "from_centroids", "ivf_train", "ivf_add", "ivf_probe", "probed", "probe_one", "ivf_search",
    "ivf_search_batch", "ivf_list_sizes", "ivf_size", "ivf_stats", "ivf_save", "ivf_load", "ivf_clear",
    "ann", "hits_to_docs", "train_job", "recall_at_k", "centroid_frame",
]
