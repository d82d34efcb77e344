"""K-means and the IVF index over the embeddings table.

SQL-checked jobs use the fixture conventions: centroids = embeddings of
vec_id 0-9 (cluster_id = vec_id), single query vec_id 0, nprobe 3, k 5; batch
queries are all rows whose id is divisible by 100; metric-sensitive jobs run on ``fx_scaled_embeddings``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quiver.operators import ivf as ivfm
from quiver.operators.kmeans import (
    SEED,
    assign_clusters,
    kmeans_init,
    kmeans_train,
    lloyd_step,
    relative_change_frame,
    reseed_empty,
)
from quiver.operators.knn import exact_knn_join
from quiver.plans import sqlx
from quiver.plans.registry import job
from quiver.plans.vector_plans import BATCH_EVERY, SINGLE_QUERY, batch_queries, knn_join_body, knn_oracle
from quiver.session import scratch_path
from quiver.sources.fixtures import spark_view, with_views
from quiver.sources.tables import table

NCENT = 10
NPROBE = 3
K = 5


def emb(spark, sf_dir, scaled: bool):
    return spark_view(spark, sf_dir, "fx_scaled_embeddings") if scaled else table(spark, sf_dir, "embeddings")


def given_centroids(e, extra_empty: bool = False):
    c = e.where(F.col("vec_id") < NCENT).select(F.col("vec_id").alias("cluster_id"),
                                                 F.col("embedding").cast("array<double>").alias("centroid"))
    if extra_empty:  # copies of centroids 0 and 1 under ids 10, 11: always lose the tie -> empty lists
        c = c.unionByName(e.where(F.col("vec_id") < 2).select(
            (F.col("vec_id") + NCENT).alias("cluster_id"), F.col("embedding").cast("array<double>").alias("centroid")))
    return c


def index_for(spark, sf_dir, metric, scaled=True, extra_empty=False):
    e = emb(spark, sf_dir, scaled)
    idx = ivfm.from_centroids(given_centroids(e, extra_empty), metric)
    return e, idx


# ---------------------------------------------------------------- SQL pieces
def _view(scaled):
    return "fx_scaled_embeddings" if scaled else "embeddings"


def cent_cte(scaled, extra_empty=False):
    v = _view(scaled)
    s = f"SELECT vec_id AS cluster_id, embedding AS centroid FROM {v} WHERE vec_id < {NCENT}"
    if extra_empty:
        s += f" UNION ALL SELECT vec_id + {NCENT} AS cluster_id, embedding AS centroid FROM {v} WHERE vec_id < 2"
    return ("cent", s)


def assign_cte(metric, scaled):
    v = _view(scaled)
    s = sqlx.score(metric, "e.embedding", "c.centroid")
    return ("assign", f"SELECT vec_id, cluster_id, raw FROM (SELECT e.vec_id, c.cluster_id, {s} AS raw, "
                      f"row_number() OVER (PARTITION BY e.vec_id ORDER BY {s} {'ASC' if metric == 'l2' else 'DESC'}, c.cluster_id) AS r "
                      f"FROM {v} e, cent c) t WHERE r = 1")


BATCH = f"q.vec_id % {BATCH_EVERY} = 0"
SINGLE = f"q.vec_id = {SINGLE_QUERY}"


def probes_cte(metric, scaled, nprobe=NPROBE, which=BATCH):
    v = _view(scaled)
    s = sqlx.score(metric, "q.embedding", "c.centroid")
    return ("probes", f"SELECT query_id, rank, cluster_id, raw FROM (SELECT q.vec_id AS query_id, c.cluster_id, {s} AS raw, "
                      f"row_number() OVER (PARTITION BY q.vec_id ORDER BY {s} {'ASC' if metric == 'l2' else 'DESC'}, c.cluster_id) AS rank "
                      f"FROM {v} q, cent c WHERE {which}) t WHERE rank <= {nprobe}")


def search_body(metric, scaled, k=K, cols="query_id, rank, doc_id"):
    v = _view(scaled)
    s = sqlx.score(metric, "e.embedding", "q.embedding")
    return (f"SELECT {cols}, round(raw, 6) AS score FROM (SELECT p.query_id, a.vec_id AS doc_id, {s} AS raw, "
            f"row_number() OVER (PARTITION BY p.query_id ORDER BY {s} {'ASC' if metric == 'l2' else 'DESC'}, a.vec_id) AS rank "
            f"FROM probes p JOIN assign a ON a.cluster_id = p.cluster_id JOIN {v} e ON e.vec_id = a.vec_id "
            f"JOIN {v} q ON q.vec_id = p.query_id) t WHERE rank <= {k}")


def search_oracle(metric, scaled=True, k=K, nprobe=NPROBE):
    views = ["fx_scaled_embeddings"] if scaled else []
    return with_views(search_body(metric, scaled, k), views,
                      [cent_cte(scaled), assign_cte(metric, scaled), probes_cte(metric, scaled, nprobe)])


SCALED_VIEWS = ["fx_scaled_embeddings"]

# ---------------------------------------------------------------- C: k-means


@job("C1_kmeans_init", with_views(
    f"SELECT CAST(row_number() OVER (ORDER BY md5(concat('{SEED}', ':', CAST(vec_id AS VARCHAR))), vec_id) - 1 AS BIGINT) AS cluster_id, vec_id "
    f"FROM embeddings ORDER BY md5(concat('{SEED}', ':', CAST(vec_id AS VARCHAR))), vec_id LIMIT {NCENT}"), "kmeans")
def c1(spark, sf_dir):
    return kmeans_init(table(spark, sf_dir, "embeddings"), NCENT).select("cluster_id", "vec_id")


@job("C2_kmeans_assign", with_views(
    "SELECT vec_id, cluster_id, round(raw, 6) AS distance FROM assign", [],
    [cent_cte(False), assign_cte("l2", False)]), "kmeans")
def c2(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    out = assign_clusters(e, given_centroids(e))
    return out.select("vec_id", "cluster_id", F.round("distance", 6).alias("distance"))


@job("C7_assign_clusters", with_views(
    "SELECT vec_id, cluster_id FROM assign", SCALED_VIEWS, [cent_cte(True), assign_cte("l2", True)]), "kmeans")
def c7(spark, sf_dir):
    e = emb(spark, sf_dir, True)
    return assign_clusters(e, given_centroids(e)).select("vec_id", "cluster_id")


_UPDATE_SQL = with_views(
    "SELECT a.cluster_id, count(*) AS n, "
    "list_transform(list_reduce(list(CAST(e.embedding AS DOUBLE[])), lambda x, y: list_transform(list_zip(x, y), lambda p: p[1] + p[2])), "
    "lambda v: round(v / count(*), 6)) AS centroid "
    "FROM assign a JOIN embeddings e ON e.vec_id = a.vec_id GROUP BY a.cluster_id", [],
    [cent_cte(False), assign_cte("l2", False)])


@job("C3_kmeans_update", _UPDATE_SQL, "kmeans")
def c3(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    step = lloyd_step(e.select(F.col("embedding").cast("array<double>").alias("embedding")), given_centroids(e))
    return step.select("cluster_id", "n", F.transform("centroid", lambda v: F.round(v, 6)).alias("centroid"))


@job("C4_kmeans_reseed_empty", with_views(
    "SELECT cluster_id, vec_id AS reseed_vec_id FROM ("
    "SELECT s.cluster_id, r.vec_id FROM (SELECT cluster_id, row_number() OVER (ORDER BY cluster_id) AS r FROM cent "
    "WHERE cluster_id NOT IN (SELECT DISTINCT cluster_id FROM assign)) s JOIN ("
    f"SELECT vec_id, row_number() OVER (ORDER BY md5(concat('{SEED}', ':', '1', ':', CAST(vec_id AS VARCHAR))), vec_id) AS r FROM embeddings) r "
    "ON r.r = s.r) t", [], [cent_cte(False, True), assign_cte("l2", False)]), "kmeans")
def c4(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    cent = given_centroids(e, extra_empty=True)
    data = e.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    step = lloyd_step(data, cent)
    # ids of empty clusters: at most nlist values, decided on the driver like the trainer does
    present = {r[0] for r in step.select("cluster_id").collect()}
    empty = [r[0] for r in cent.select("cluster_id").collect() if r[0] not in present]
    return reseed_empty(data, empty, SEED, 1).select("cluster_id", F.col("vec_id").alias("reseed_vec_id"))


@job("C5_kmeans_converged", with_views(
    "SELECT round(sum(list_distance(CAST(c.centroid AS DOUBLE[]), u.centroid)), 6) AS total_change, "
    "round(sum(sqrt(list_inner_product(u.centroid, u.centroid))), 6) AS total_norm, "
    "round(sum(list_distance(CAST(c.centroid AS DOUBLE[]), u.centroid)) / (sum(sqrt(list_inner_product(u.centroid, u.centroid))) + 1e-8), 6) AS relative_change, "
    "sum(list_distance(CAST(c.centroid AS DOUBLE[]), u.centroid)) / (sum(sqrt(list_inner_product(u.centroid, u.centroid))) + 1e-8) < 0.001 AS converged "
    "FROM cent c JOIN upd u ON u.cluster_id = c.cluster_id", [],
    [cent_cte(False), assign_cte("l2", False),
     ("upd", "SELECT a.cluster_id, list_transform(list_reduce(list(CAST(e.embedding AS DOUBLE[])), "
             "lambda x, y: list_transform(list_zip(x, y), lambda p: p[1] + p[2])), lambda v: v / count(*)) AS centroid "
             "FROM assign a JOIN embeddings e ON e.vec_id = a.vec_id GROUP BY a.cluster_id")]), "kmeans")
def c5(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    cent = given_centroids(e)
    new = lloyd_step(e.select(F.col("embedding").cast("array<double>").alias("embedding")), cent)
    r = relative_change_frame(cent, new.select("cluster_id", "centroid"))
    return r.select(F.round("total_change", 6).alias("total_change"), F.round("total_norm", 6).alias("total_norm"),
                    F.round("relative_change", 6).alias("relative_change"), "converged")


# The whole training as one recursive query: every step assigns each vector (keeping its old centroid
# beside it), takes the means, and stops by the relative change.  Clusters that empty are not seeded anew
# here; on the given tables none does.
_ORDER = f"md5(concat('{SEED}', ':', CAST(vec_id AS VARCHAR))), vec_id"
_TRAINED = f"""WITH RECURSIVE seeds AS (SELECT CAST(row_number() OVER (ORDER BY {_ORDER}) - 1 AS BIGINT) AS cluster_id,
    CAST(embedding AS DOUBLE[]) AS centroid FROM embeddings WHERE embedding IS NOT NULL ORDER BY {_ORDER} LIMIT {NCENT}),
km(it, cluster_id, centroid, done) AS (SELECT 0, cluster_id, centroid, false FROM seeds
    UNION ALL
    SELECT it, cluster_id, centroid, sum(list_distance(old, centroid)) OVER () / (sum(sqrt(list_inner_product(centroid, centroid))) OVER () + 1e-8) < 0.001
    FROM (SELECT it, best.cluster_id AS cluster_id, any_value(best.old) AS old,
            list_transform(list_reduce(list(v ORDER BY vec_id), lambda x, y: list_transform(list_zip(x, y), lambda p: p[1] + p[2])),
                           lambda s: s / count(*)) AS centroid
        FROM (SELECT e.vec_id, any_value(CAST(e.embedding AS DOUBLE[])) AS v, min(k.it) + 1 AS it,
                arg_min(struct_pack(cluster_id := k.cluster_id, old := k.centroid),
                        struct_pack(d := {sqlx.l2('e.embedding', 'k.centroid')}, i := k.cluster_id)) AS best
            FROM embeddings e, km k WHERE NOT k.done AND k.it < 100 AND e.embedding IS NOT NULL GROUP BY e.vec_id)
        GROUP BY it, best.cluster_id)),
trained AS (SELECT cluster_id, centroid, CAST(it AS BIGINT) AS iterations, done AS converged FROM km WHERE it = (SELECT max(it) FROM km))
"""


@job("C6_kmeans_train", _TRAINED + "SELECT cluster_id, list_transform(centroid, lambda v: round(v, 6)) AS centroid, iterations, converged FROM trained",
     "kmeans")
def c6(spark, sf_dir):
    """Full Lloyd loop: nlist 10 on the embeddings."""
    res = kmeans_train(table(spark, sf_dir, "embeddings"), NCENT)
    return res.centroids.select("cluster_id", F.transform("centroid", lambda v: F.round(v, 6)).alias("centroid"),
                                F.lit(res.iterations).alias("iterations"), F.lit(res.converged).alias("converged"))


# ---------------------------------------------------------------- I: IVF


@job("I1_ivf_train", _TRAINED + f""", near AS (SELECT e.vec_id, arg_min(t.cluster_id, struct_pack(d := {sqlx.l2('e.embedding', 't.centroid')}, i := t.cluster_id)) AS cluster_id
    FROM embeddings e, trained t GROUP BY e.vec_id)
SELECT t.cluster_id, CAST(count(n.vec_id) AS BIGINT) AS n FROM trained t LEFT JOIN near n ON n.cluster_id = t.cluster_id GROUP BY t.cluster_id""", "ivf")
def i1(spark, sf_dir):
    """Train nlist 10 on the embeddings, then list sizes."""
    e = table(spark, sf_dir, "embeddings")
    idx = ivfm.ivf_train(e, nlist=NCENT, metric="l2")
    return ivfm.ivf_list_sizes(idx, ivfm.ivf_add(idx, e))


def _add_job(metric, name):
    @job(name, with_views("SELECT vec_id AS doc_id, cluster_id FROM assign", SCALED_VIEWS,
                          [cent_cte(True), assign_cte(metric, True)]), "ivf")
    def run(spark, sf_dir):
        e, idx = index_for(spark, sf_dir, metric)
        return ivfm.ivf_add(idx, e).select("doc_id", "cluster_id")


_add_job("l2", "I2_ivf_add")
_add_job("cosine", "I2_ivf_add_cosine")
_add_job("dot", "I2_ivf_add_dot")


@job("I3_ivf_bulk_add", with_views("SELECT vec_id AS doc_id, cluster_id FROM assign", SCALED_VIEWS,
                                   [cent_cte(True), assign_cte("cosine", True)]), "ivf")
def i3(spark, sf_dir):
    """Two bulk adds (ids below / from 250) appended into one list table."""
    e, idx = index_for(spark, sf_dir, "cosine")
    a = ivfm.ivf_add(idx, e.where(F.col("vec_id") < 250))
    b = ivfm.ivf_add(idx, e.where(F.col("vec_id") >= 250))
    return a.unionByName(b).select("doc_id", "cluster_id")


def _probe_job(metric, name):
    @job(name, with_views("SELECT query_id, rank, cluster_id, round(raw, 6) AS score FROM probes", SCALED_VIEWS,
                          [cent_cte(True), probes_cte(metric, True)]), "ivf")
    def run(spark, sf_dir):
        e, idx = index_for(spark, sf_dir, metric)
        return ivfm.ivf_probe(idx, batch_queries(e), NPROBE)


_probe_job("l2", "I4_ivf_probe")
_probe_job("dot", "I4_ivf_probe_dot")


def single_search_ctes(metric, nprobe=NPROBE):
    return [cent_cte(True), assign_cte(metric, True), probes_cte(metric, True, nprobe, SINGLE)]


def single_search_oracle(metric, k=K, nprobe=NPROBE):
    return with_views(search_body(metric, True, k, cols="rank, doc_id"), SCALED_VIEWS, single_search_ctes(metric, nprobe))


def _search_job(metric, name):
    @job(name, single_search_oracle(metric), "ivf")
    def run(spark, sf_dir):
        e, idx = index_for(spark, sf_dir, metric)
        lists = ivfm.ivf_add(idx, e)
        q = e.where(F.col("vec_id") == SINGLE_QUERY).select("embedding").first()[0]
        return ivfm.ivf_search(idx, lists, q, k=K, nprobe=NPROBE)


_search_job("l2", "I5_ivf_search")
_search_job("cosine", "I5_ivf_search_cosine")
_search_job("dot", "I5_ivf_search_dot")


def _batch_job(metric, name):
    @job(name, search_oracle(metric), "ivf")
    def run(spark, sf_dir):
        e, idx = index_for(spark, sf_dir, metric)
        lists = ivfm.ivf_add(idx, e)
        return ivfm.ivf_search_batch(idx, lists, batch_queries(e), k=K, nprobe=NPROBE)


_batch_job("l2", "I6_ivf_search_batch")
_batch_job("cosine", "I6_ivf_search_batch_cosine")
_batch_job("dot", "I6_ivf_search_batch_dot")


_ORDER_SQL = with_views(
    " UNION ALL ".join(
        f"SELECT '{m}' AS metric, rank, cluster_id, round(raw, 6) AS score FROM ("
        f"SELECT c.cluster_id, {sqlx.score(m, 'q.embedding', 'c.centroid')} AS raw, "
        f"row_number() OVER (ORDER BY {sqlx.score(m, 'q.embedding', 'c.centroid')} {'ASC' if m == 'l2' else 'DESC'}, c.cluster_id) AS rank "
        f"FROM cent c, (SELECT embedding FROM fx_scaled_embeddings WHERE vec_id = {SINGLE_QUERY}) q) t{i}"
        for i, m in enumerate(("l2", "cosine", "dot"))),
    SCALED_VIEWS, [cent_cte(True)])


@job("I7_ivf_metric_order", _ORDER_SQL, "ivf")
def i7(spark, sf_dir):
    """Every centroid ranked for query 0 under each metric (better-score rule and order)."""
    out = None
    for m in ("l2", "cosine", "dot"):
        e, idx = index_for(spark, sf_dir, m)
        q = e.where(F.col("vec_id") == SINGLE_QUERY).select("embedding", F.lit(0).alias("query_id"))
        r = ivfm.ivf_probe(idx, q, idx.nlist).select(F.lit(m).alias("metric"), "rank", "cluster_id", "score")
        out = r if out is None else out.unionByName(r)
    return out


_SIZES_CTES = [cent_cte(True, True), assign_cte("l2", True),
               ("sizes", "SELECT c.cluster_id, CAST(count(a.vec_id) AS BIGINT) AS n FROM cent c "
                         "LEFT JOIN assign a ON a.cluster_id = c.cluster_id GROUP BY c.cluster_id")]


@job("I8_ivf_stats", with_views(
    f"SELECT CAST({NCENT + 2} AS BIGINT) AS nlist, CAST(64 AS BIGINT) AS dimension, 'l2' AS metric_type, true AS is_trained, "
    "CAST(sum(n) AS BIGINT) AS total_vectors, min(n) AS min_cluster_size, max(n) AS max_cluster_size, "
    f"round(sum(n) / {NCENT + 2}, 6) AS avg_cluster_size FROM sizes", SCALED_VIEWS, _SIZES_CTES), "ivf")
def i8(spark, sf_dir):
    e, idx = index_for(spark, sf_dir, "l2", extra_empty=True)
    return ivfm.ivf_stats(idx, ivfm.ivf_add(idx, e))


@job("I9_ivf_list_sizes", with_views("SELECT cluster_id, n FROM sizes", SCALED_VIEWS, _SIZES_CTES), "ivf")
def i9(spark, sf_dir):
    e, idx = index_for(spark, sf_dir, "l2", extra_empty=True)
    return ivfm.ivf_list_sizes(idx, ivfm.ivf_add(idx, e))


@job("I10_ivf_clear", with_views("SELECT cluster_id, CAST(0 AS BIGINT) AS n FROM cent", SCALED_VIEWS,
                                 [cent_cte(True)]), "ivf")
def i10(spark, sf_dir):
    """Save, clear (centroids kept), reload: every list is empty."""
    e, idx = index_for(spark, sf_dir, "l2")
    path = scratch_path(spark, "ivf-clear")
    ivfm.ivf_save(idx, ivfm.ivf_add(idx, e), path)
    idx2, lists = ivfm.ivf_load(spark, path)
    cleared = ivfm.ivf_clear(idx2, lists, path + "-cleared")
    return ivfm.ivf_list_sizes(idx2, cleared)


@job("I11_ivf_save_load", search_oracle("l2"), "ivf")
def i11(spark, sf_dir):
    """Persist the index (lists partitioned by cluster_id), reload, batch-search."""
    e, idx = index_for(spark, sf_dir, "l2")
    path = scratch_path(spark, "ivf-index")
    ivfm.ivf_save(idx, ivfm.ivf_add(idx, e), path)
    idx2, lists = ivfm.ivf_load(spark, path)
    return ivfm.ivf_search_batch(idx2, lists, batch_queries(e), k=K, nprobe=NPROBE)


@job("I12_ann_query", knn_oracle("l2", 10, id_alias="doc_id"), "ivf")
def i12(spark, sf_dir):
    """ANN query with defaults (nprobe 10, k 10) on a 10-list index = exact top-10."""
    e, idx = index_for(spark, sf_dir, "l2")
    q = e.where(F.col("vec_id") == SINGLE_QUERY).select("embedding").first()[0]
    return ivfm.ann(idx, ivfm.ivf_add(idx, e), q)


@job("I13_ann_hits_to_docs", with_views(
    "SELECT d.doc_id, h.rank, h.score, d.lang, d.source, d.n_chars FROM documents d JOIN ("
    + search_body("l2", True, K, cols="rank, doc_id") + ") h ON h.doc_id = d.doc_id", SCALED_VIEWS,
    single_search_ctes("l2")), "ivf")
def i13(spark, sf_dir):
    e, idx = index_for(spark, sf_dir, "l2")
    q = e.where(F.col("vec_id") == SINGLE_QUERY).select("embedding").first()[0]
    hits = ivfm.ivf_search(idx, ivfm.ivf_add(idx, e), q, k=K, nprobe=NPROBE)
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return ivfm.hits_to_docs(docs, hits).select("doc_id", "rank", "score", "lang", "source", "n_chars")


@job("I14_ivf_train_job", with_views(
    f"SELECT true AS success, 'IVF index trained successfully with {NCENT} clusters' AS message, "
    f"CAST(count(*) AS BIGINT) AS vector_count, CAST({NCENT} AS BIGINT) AS nlist FROM embeddings WHERE embedding IS NOT NULL"), "ivf")
def i14(spark, sf_dir):
    out, _ = ivfm.train_job(table(spark, sf_dir, "embeddings"), "embeddings", "embedding", nlist=NCENT)
    return out


_RECALL_CTES = [cent_cte(True), assign_cte("l2", True), probes_cte("l2", True, 1),
                ("approx", search_body("l2", True, 10)),
                ("exact", knn_join_body("l2", 10))]


@job("I16_recall_at_k", with_views(
    "SELECT x.query_id, round(count(a.doc_id) / 10.0, 6) AS recall FROM exact x "
    "LEFT JOIN approx a ON a.query_id = x.query_id AND a.doc_id = x.vec_id GROUP BY x.query_id",
    SCALED_VIEWS, _RECALL_CTES), "ivf")
def i16(spark, sf_dir):
    """Recall@10 of IVF (nprobe 1) against exact search, over all queries."""
    e, idx = index_for(spark, sf_dir, "l2")
    qs = batch_queries(e)
    approx = ivfm.ivf_search_batch(idx, ivfm.ivf_add(idx, e), qs, k=10, nprobe=1)
    exact = exact_knn_join(e, qs, 10, "l2")
    return ivfm.recall_at_k(approx, exact, 10)
