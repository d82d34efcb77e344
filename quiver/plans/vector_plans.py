"""Similarity and exact search over the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from quiver.functions.vector import cosine_similarity, dot_product, l2_distance, round_score
from quiver.operators.knn import exact_knn, exact_knn_join, query_vector, score_all
from quiver.plans import sqlx
from quiver.plans.registry import job
from quiver.sources.fixtures import spark_view, with_views

METRICS = ("l2", "cosine", "dot")
SINGLE_QUERY = 0          # FIXTURES: single query = vec_id 0
BATCH_EVERY = 100         # query table: every vector whose id is divisible by 100, against all


def scaled(spark, sf_dir):
    return spark_view(spark, sf_dir, "fx_scaled_embeddings")


def batch_queries(emb):
    return emb.where(F.col("vec_id") % BATCH_EVERY == 0).select(F.col("vec_id").alias("query_id"), "embedding")


# V1-V3: pairwise score of each vector with its successor (equi-join on id + 1).
_PAIR_FNS = {"l2": l2_distance, "cosine": cosine_similarity, "dot": dot_product}
_PAIR_IDS = {"l2": "V1_l2_distance", "cosine": "V2_cosine_similarity", "dot": "V3_dot_product"}


def _pair_job(metric):
    def run(spark, sf_dir):
        e = scaled(spark, sf_dir)
        a, b = e.alias("a"), e.alias("b")
        j = a.join(b, F.col("b.vec_id") == F.col("a.vec_id") + 1)
        return j.select(F.col("a.vec_id").alias("vec_id"),
                        round_score(_PAIR_FNS[metric]("a.embedding", "b.embedding")).alias("score"))

    sql = with_views(
        f"SELECT a.vec_id, round({sqlx.score(metric, 'a.embedding', 'b.embedding')}, 6) AS score "
        "FROM fx_scaled_embeddings a JOIN fx_scaled_embeddings b ON b.vec_id = a.vec_id + 1",
        ["fx_scaled_embeddings"],
    )
    job(_PAIR_IDS[metric], sql, "vector")(run)


# V4-V6: one query against every vector, id order kept by the key column.
_BATCH_IDS = {"l2": "V4_batch_l2", "cosine": "V5_batch_cosine", "dot": "V6_batch_dot"}


def _batch_job(metric):
    def run(spark, sf_dir):
        e = scaled(spark, sf_dir)
        return score_all(e, query_vector(e, SINGLE_QUERY), metric)

    sql = with_views(
        f"SELECT e.vec_id, round({sqlx.score(metric, 'e.embedding', 'q.embedding')}, 6) AS score "
        f"FROM fx_scaled_embeddings e, (SELECT embedding FROM fx_scaled_embeddings WHERE vec_id = {SINGLE_QUERY}) q",
        ["fx_scaled_embeddings"],
    )
    job(_BATCH_IDS[metric], sql, "vector")(run)


# V7-V9: brute-force top-10 for one query.
_KNN_IDS = {"l2": "V7_exact_knn_l2", "cosine": "V8_exact_knn_cosine", "dot": "V9_exact_knn_dot"}


def knn_body(metric: str, k: int, view: str = "fx_scaled_embeddings", qid: int = SINGLE_QUERY,
             id_alias: str = "vec_id") -> str:
    s = sqlx.score(metric, "e.embedding", "q.embedding")
    return (f"SELECT rank, vec_id AS {id_alias}, round(raw, 6) AS score FROM ("
            f"SELECT e.vec_id, {s} AS raw, row_number() OVER (ORDER BY {s} {'ASC' if metric == 'l2' else 'DESC'}, e.vec_id) AS rank "
            f"FROM {view} e, (SELECT embedding FROM {view} WHERE vec_id = {qid}) q) t WHERE rank <= {k}")


def knn_oracle(metric: str, k: int, view: str = "fx_scaled_embeddings", qid: int = SINGLE_QUERY,
               id_alias: str = "vec_id") -> str:
    return with_views(knn_body(metric, k, view, qid, id_alias), [view] if view.startswith("fx_") else [])


def _knn_job(metric):
    def run(spark, sf_dir):
        e = scaled(spark, sf_dir)
        return exact_knn(e, query_vector(e, SINGLE_QUERY), 10, metric)

    job(_KNN_IDS[metric], knn_oracle(metric, 10), "vector")(run)


def knn_join_body(metric: str, k: int, view: str = "fx_scaled_embeddings") -> str:
    s = sqlx.score(metric, "e.embedding", "q.embedding")
    return (f"SELECT query_id, rank, vec_id, round(raw, 6) AS score FROM ("
            f"SELECT q.vec_id AS query_id, e.vec_id, {s} AS raw, "
            f"row_number() OVER (PARTITION BY q.vec_id ORDER BY {s} {'ASC' if metric == 'l2' else 'DESC'}, e.vec_id) AS rank "
            f"FROM {view} e, (SELECT vec_id, embedding FROM {view} WHERE vec_id % {BATCH_EVERY} = 0) q) t WHERE rank <= {k}")


def knn_join_oracle(metric: str, k: int, view: str = "fx_scaled_embeddings") -> str:
    return with_views(knn_join_body(metric, k, view), [view] if view.startswith("fx_") else [])


def _knn_join_job(metric):
    def run(spark, sf_dir):
        e = scaled(spark, sf_dir)
        return exact_knn_join(e, batch_queries(e), 5, metric)

    name = "V10_exact_knn_join" + ("" if metric == "l2" else f"_{metric}")
    job(name, knn_join_oracle(metric, 5), "vector")(run)


for _m in METRICS:
    _pair_job(_m)
    _batch_job(_m)
    _knn_job(_m)
    _knn_join_job(_m)
