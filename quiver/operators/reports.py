"""Reports over metric, deployment-report and search-log tables: A1-A9."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.functions.text import parse_cpu, parse_memory_mib, parse_percent
from quiver.operators.tenants import latest_per_key
from quiver.operators.windows import descending_position

# The ten deployment stages a report can carry.
REPORT_STAGES = ["starting", "namespace_created", "gitlab_pulled", "k8s_applied", "resources_configured",
                 "disk_configured", "gpu_configured", "rollout_completed", "tenant_synced", "completed"]
RFC3339_PATTERN = "yyyy-MM-dd'T'HH:mm:ss'Z'"
REPORT_TICK = "60 seconds"
PERCENTILE_ACCURACY = 100000


def latest_metrics(metrics: DataFrame, key: str = "namespace") -> DataFrame:
    """A1: newest row per key by (ts, id)."""
    return latest_per_key(metrics, [key], ["ts", "id"])


def latest_report(reports: DataFrame, time_col: str = "report_time") -> DataFrame:
    """A2: newest report per (user, service); rows whose RFC3339 time does not parse are skipped."""
    # TIMESTAMP_NTZ after a shape check: independent of the session time zone
    ok = F.col(time_col).rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$")
    parsed = reports.withColumn("_t", F.when(ok, F.to_timestamp_ntz(F.col(time_col), F.lit(RFC3339_PATTERN))))
    ok = parsed.where(F.col("_t").isNotNull())
    out = latest_per_key(ok, ["user_id", "service_name"], ["_t", "id"])
    return out.drop("_t")


def report_status_counts(reports: DataFrame, stages: list[str] = REPORT_STAGES) -> DataFrame:
    """A4: count per stage over the fixed stage list; zero rows shown, other values dropped."""
    spark = reports.sparkSession
    st = spark.createDataFrame([(i, s) for i, s in enumerate(stages)], "stage_order int, status string")
    counts = reports.groupBy("status").agg(F.count(F.lit(1)).alias("reports"))
    return F.broadcast(st).join(counts, "status", "left") \
        .select("stage_order", "status", F.coalesce("reports", F.lit(0)).cast("long").alias("reports"))


def report_history(reports: DataFrame, text_cols: list[str]) -> DataFrame:
    """A5: newest-first position per (user, service); missing text fields shown as ``N/A``."""
    out = descending_position(reports, ["user_id", "service_name"], "ts", "id")
    for c in text_cols:
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit("N/A")))
    return out


def index_stats_report(docs: DataFrame, metadata: DataFrame) -> DataFrame:
    """Documents and size per index, with the index's declared metadata."""
    agg = docs.groupBy("index_name").agg(F.count(F.lit(1)).alias("doc_count"), F.sum("n_chars").alias("size_chars"))
    return agg.join(metadata, "index_name", "left")


def qps_latency_stats(search_log: DataFrame, key: str = "index_name", tick: str = REPORT_TICK,
                      tick_seconds: int = 60) -> DataFrame:
    """Per key and report tick: qps = count / tick, avg, p95, p99 latency.

    Percentiles use the bounded-memory quantile sketch, so a hot index never
    holds all its latencies in one task.
    """
    g = search_log.groupBy(key, F.window("ts", tick).alias("w")).agg(
        F.count(F.lit(1)).alias("queries"),
        F.avg("latency_ms").alias("avg_latency"),
        F.percentile_approx("latency_ms", 0.95, PERCENTILE_ACCURACY).alias("p95_latency"),
        F.percentile_approx("latency_ms", 0.99, PERCENTILE_ACCURACY).alias("p99_latency"))
    return g.select(key, F.col("w.start").alias("window_start"), "queries",
                    F.round(F.col("queries") / F.lit(float(tick_seconds)), 6).alias("qps"),
                    F.round("avg_latency", 6).alias("avg_latency"), "p95_latency", "p99_latency")


def lifecycle_events(old: DataFrame, new: DataFrame, key: str = "index_name") -> DataFrame:
    """Change feed between two metadata snapshots: index_created / index_deleted."""
    o = old.select(key, F.lit(True).alias("_o"))
    n = new.select(key, F.lit(True).alias("_n"))
    j = o.join(n, key, "full_outer")
    ev = F.when(F.col("_o").isNull(), F.lit("index_created")).when(F.col("_n").isNull(), F.lit("index_deleted"))
    return j.select(key, ev.alias("event_type")).where(F.col("event_type").isNotNull())


def fleet_usage(pods: DataFrame, first_pod_only: bool = False) -> DataFrame:
    """Current usage by namespace summed over all pods (latest sample per pod).

    ``first_pod_only`` keeps the reference's behaviour of reading one pod.
    """
    parsed = pods.select("id", "namespace", "pod", "ts", parse_cpu("cpu_text").alias("cpu_cores"),
                         parse_memory_mib("mem_text").alias("memory_mib"), parse_percent("disk_text").alias("disk_pct"))
    latest = latest_per_key(parsed, ["namespace", "pod"], ["ts", "id"])
    if first_pod_only:
        cols = [c for c in latest.columns if c != "namespace"]
        first = latest.groupBy("namespace").agg(F.min_by(F.struct(*cols), F.col("pod")).alias("_r"))
        latest = first.select("namespace", *[F.col(f"_r.{c}").alias(c) for c in cols])
    return latest.groupBy("namespace").agg(
        F.count(F.lit(1)).alias("pods"), F.round(F.sum("cpu_cores"), 6).alias("cpu_cores"),
        F.round(F.sum("memory_mib"), 6).alias("memory_mib"), F.round(F.avg("disk_pct"), 6).alias("disk_pct"))
