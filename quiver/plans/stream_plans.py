"""Streaming jobs, each checked as stream result = batch result (same oracle SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quiver.operators.scaling import effective_policy
from quiver.operators.tenants import quota_check
from quiver.plans import index_plans as IP
from quiver.plans import log_plans as LP
from quiver.plans import metric_plans as MP
from quiver.plans.registry import ORACLE, job
from quiver.session import scratch_path
from quiver.sources.fixtures import spark_view, with_views
from quiver.streaming import ingest, scaler
from quiver.streaming.logs import STATE_STORE, kube_log_stream, multiline_stream
from quiver.streaming.reports import qps_latency_stream
from quiver.streaming.sources import idempotent_batch_writer, stage_files

WEEKS = [0, 1, 2, 3]


def v(spark, sf_dir, name):
    return spark_view(spark, sf_dir, name)


def _run(q):
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


class state_partitions:
    """Size the state store of a new stateful stream (fixed at its first batch) to the
    cluster's parallelism instead of an arbitrary session-wide shuffle setting; ``store``
    is its provider, where it needs another than the session's."""

    def __init__(self, spark, store: str | None = None):
        self.spark = spark
        self.conf = {"spark.sql.shuffle.partitions": str(spark.sparkContext.defaultParallelism),
                     **({"spark.sql.streaming.stateStore.providerClass": store} if store else {})}

    def __enter__(self):
        self.old = {k: self.spark.conf.get(k) for k in self.conf}
        for k, v in self.conf.items():
            self.spark.conf.set(k, v)

    def __exit__(self, *exc):
        for k, v in self.old.items():
            self.spark.conf.set(k, v)


@job("I15_ivf_ingest_stream", with_views(
    "SELECT c.cluster_id, CAST(count(a.vec_id) AS BIGINT) AS n FROM cent c LEFT JOIN assign a ON a.cluster_id = c.cluster_id GROUP BY c.cluster_id",
    IP.SCALED_VIEWS, [IP.cent_cte(True), IP.assign_cte("l2", True)]), "stream")
def i15(spark, sf_dir):
    """Vectors arrive as four files, one micro-batch each; the lists are then counted."""
    e, idx = IP.index_for(spark, sf_dir, "l2")
    base = scratch_path(spark, "ivf-stream")
    stage_files(e, f"{base}/in", F.floor(F.col("vec_id") / 128) % 4, WEEKS)
    src = ingest.read_stream(spark, f"{base}/in", e.schema)
    _run(ingest.ivf_ingest_stream(idx, src, f"{base}/lists", f"{base}/ckpt"))
    from quiver.operators.ivf import ivf_list_sizes

    return ivf_list_sizes(idx, spark.read.parquet(f"{base}/lists"))


def _week(col="ts"):
    return F.floor(F.dayofmonth(col) / 8)


@job("S7_metrics_append_stream", ORACLE["S7_metrics_append"], "stream")
def s7s(spark, sf_dir):
    m = v(spark, sf_dir, "fx_metrics")
    base = scratch_path(spark, "metrics-stream")
    stage_files(m, f"{base}/in", _week(), WEEKS)
    _run(ingest.metrics_append_stream(ingest.read_stream(spark, f"{base}/in", m.schema), f"{base}/out", f"{base}/ckpt"))
    return spark.read.parquet(f"{base}/out")


def namespace_inputs(spark, sf_dir):
    deps = v(spark, sf_dir, "fx_ns_deployments")
    pol = effective_policy(deps, v(spark, sf_dir, "fx_policies"))
    q = quota_check(deps.select(F.col("user_id").alias("tenant_id")), v(spark, sf_dir, "fx_tenant_quota"))
    return pol.join(q.select(F.col("tenant_id").alias("user_id"), F.col("allowed").alias("quota_ok")), "user_id", "left")


@job("M13_scaling_recommendations_stream", MP.scan_sql(static=False), "stream")
def m13s(spark, sf_dir):
    """Metric samples arrive week by week; keyed state carries history, replicas and cooldown."""
    m = v(spark, sf_dir, "fx_metrics")
    base = scratch_path(spark, "scaler-stream")
    stage_files(m, f"{base}/in", _week(), WEEKS)
    decisions = scaler.scaling_stream(ingest.read_stream(spark, f"{base}/in", m.schema), namespace_inputs(spark, sf_dir))
    with state_partitions(spark):
        q = decisions.writeStream.foreachBatch(idempotent_batch_writer(f"{base}/out", [])) \
            .option("checkpointLocation", f"{base}/ckpt").outputMode("append").trigger(availableNow=True).start()
        _run(q)
    return spark.read.parquet(f"{base}/out").drop("batch_id")


@job("L6_log_enrich_stream", ORACLE["L6_log_enrich"], "stream")
def l6s(spark, sf_dir):
    lines = v(spark, sf_dir, "fx_logs")
    base = scratch_path(spark, "log-stream")
    stage_files(lines, f"{base}/in", F.col("line_no") % 3, [0, 1, 2], fmt="json")
    src = ingest.read_stream(spark, f"{base}/in", lines.schema, fmt="json")
    out = kube_log_stream(src, LP.HOST, LP.NODE).select("line_no", "hostname", "node_name", "kubernetes_ns",
                                                       "kubernetes_pod", "kubernetes_container")
    q = out.writeStream.foreachBatch(idempotent_batch_writer(f"{base}/out", [])) \
        .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start()
    _run(q)
    return spark.read.parquet(f"{base}/out").drop("batch_id")


@job("L2_log_multiline_stream", ORACLE["L2_log_multiline"], "stream")
def l2s(spark, sf_dir):
    """Search-node log lines arrive in three files with every 17th line one file late, then a pause:
    a heartbeat hours later, which moves the time past the last record."""
    lines = v(spark, sf_dir, "fx_logs").where("tag = 'elasticsearch'").select(
        F.lit("es").alias("file"), "line_no", "raw", (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=F.col("line_no"))).alias("ts"))
    base = scratch_path(spark, "multiline-stream")
    n = lines.agg(F.max("line_no")).first()[0] or 0
    late = F.when(F.col("line_no") % 17 == 0, 1).otherwise(0)
    stage_files(lines, f"{base}/in", F.floor(F.col("line_no") * 3 / (n + 1)) + late, [0, 1, 2, 3], fmt="json")
    beat = spark.range(1).select(F.lit("es").alias("file"), F.lit(None).cast("long").alias("line_no"), F.lit(None).cast("string").alias("raw"),
                                 (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=F.lit(4 * n + 10_000))).alias("ts"))
    stage_files(beat, f"{base}/in", F.lit(0), [0], fmt="json")
    # a chunk of a large table is as many files as the table has partitions, and arrives as about one batch
    src = ingest.read_stream(spark, f"{base}/in", lines.schema, fmt="json", files_per_batch=max(1, lines.rdd.getNumPartitions()))
    with state_partitions(spark, STATE_STORE):
        _run(multiline_stream(src, delay=f"{n + 1} seconds").writeStream
             .foreachBatch(idempotent_batch_writer(f"{base}/out", []))
             .option("checkpointLocation", f"{base}/ckpt").outputMode("append").trigger(availableNow=True).start())
    return spark.read.parquet(f"{base}/out").select("record_start", "lines", "text")


@job("A7_qps_latency_stats_stream", ORACLE["A7_qps_latency_stats"], "stream")
def a7s(spark, sf_dir):
    """Search-log rows arrive week by week; per-minute windows are updated as rows come in
    (update mode, watermarked state) and the sink keeps each window's latest version."""
    from quiver.operators.tenants import latest_per_key

    log = v(spark, sf_dir, "fx_search_log")
    base = scratch_path(spark, "qps-stream")
    stage_files(log, f"{base}/in", _week(), WEEKS)
    stats = qps_latency_stream(ingest.read_stream(spark, f"{base}/in", log.schema))
    with state_partitions(spark):
        q = stats.writeStream.foreachBatch(idempotent_batch_writer(f"{base}/out", [])) \
            .option("checkpointLocation", f"{base}/ckpt").outputMode("update").trigger(availableNow=True).start()
        _run(q)
    out = spark.read.parquet(f"{base}/out")
    return latest_per_key(out, ["index_name", "window_start"], ["batch_id"]).drop("batch_id")
