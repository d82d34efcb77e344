"""Replica health, consistency and recovery analytics over shard snapshots: R1-R16.

Shard rows: ``(index_name, shard, prirep, state, docs, store, node)`` as text,
as the cluster's shard listing returns them.  Per-shard checks are one grouping by
(index, shard): the primary as an aggregate, the few replicas as a list; of an index only
the issues are gathered, as the report needs them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiver.functions.text import epoch_ms_to_rfc3339, parse_doc_count

# Thresholds and report texts.
DOC_COUNT_TOLERANCE = 10
REBALANCE_SHARDS_PER_NODE = 5
ACTIVE_RECOVERY_STATES = ["running", "retrying", "pending"]
MSG_NO_PRIMARY = "No primary shard found for shard %s"
MSG_NOT_STARTED = "Replica on %s is not STARTED (state: %s)"
MSG_DOC_MISMATCH = "Doc count mismatch: primary=%d, replica on %s=%d (diff=%d)"
MSG_NO_REPLICA = "No replica shards found for shard %s"
MSG_REPL_FAILED = "Replication failed: %.1f%% complete"
MSG_DEGRADED = "Degraded: %d unassigned shards"
MSG_INCONSISTENT = "Inconsistent: %d/%d shards"
MSG_SEVERE = "Severe: %d/%d shards inconsistent"

SHARD_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in
                             ("index_name", "shard", "prirep", "state", "docs", "store", "node")])

RECOVERY_SCHEMA = T.MapType(T.StringType(), T.StructType([T.StructField("shards", T.ArrayType(T.StructType([
    T.StructField("id", T.LongType()), T.StructField("type", T.StringType()), T.StructField("stage", T.StringType()),
    T.StructField("source", T.StructType([T.StructField("name", T.StringType())])),
    T.StructField("target", T.StructType([T.StructField("name", T.StringType())])),
    T.StructField("index", T.StructType([T.StructField("size", T.StructType([
        T.StructField("recovered_in_bytes", T.LongType()), T.StructField("total_in_bytes", T.LongType()),
        T.StructField("percent", T.StringType())]))])),
    T.StructField("start_time_in_millis", T.LongType()),
])))]))


def shard_rows(raw: DataFrame) -> DataFrame:
    """Typed shard snapshot (doc count parsed, shard number as int)."""
    return raw.select("index_name", "shard", F.regexp_extract("shard", r"^\s*([+-]?[0-9]+)", 1).try_cast("long").alias("shard_id"),
                      "prirep", "state", "docs", parse_doc_count("docs").alias("doc_count"), "store", "node")


def replication_status(shards: DataFrame, indices: DataFrame | None = None) -> DataFrame:
    """R2: per index totals, progress and final status (healthy / syncing / failed).

    Anything not STARTED is unreplicated; the progress pass overwrites the
    per-shard ``degraded`` mark, so it never survives.
    """
    s = shards if indices is None else shards.join(indices.select("index_name"), "index_name", "left_semi")
    g = s.groupBy("index_name").agg(F.count(F.lit(1)).alias("total_shards"),
                                    F.count_if(F.col("state") == "STARTED").alias("replicated_shards"))
    g = g.withColumn("unreplicated_shards", F.col("total_shards") - F.col("replicated_shards"))
    prog = F.col("replicated_shards") / F.col("total_shards") * 100.0
    status = (F.when(F.col("unreplicated_shards") == 0, F.lit("healthy"))
              .when(prog < 50, F.lit("failed")).otherwise(F.lit("syncing")))
    return g.withColumn("replication_progress", prog).withColumn("status", status)


def replication_summary(status: DataFrame) -> DataFrame:
    """Index counts by status; zeros shown."""
    return status.agg(F.count(F.lit(1)).alias("total"),
                      *[F.count_if(F.col("status") == s).alias(s) for s in ("healthy", "syncing", "degraded", "failed")])


def stuck_shards(shards: DataFrame, status: DataFrame) -> DataFrame:
    """Unassigned / initializing shard numbers of failed indices."""
    failed = status.where(F.col("status") == "failed").select("index_name")
    s = shard_rows(shards).join(failed, "index_name", "left_semi")
    return s.groupBy("index_name").agg(
        F.sort_array(F.collect_list(F.when(F.col("state") == "UNASSIGNED", F.col("shard_id")))).alias("unassigned_shards"),
        F.sort_array(F.collect_list(F.when(F.col("state") == "INITIALIZING", F.col("shard_id")))).alias("initializing_shards"))


def shard_consistency(shards: DataFrame, tolerance: int = DOC_COUNT_TOLERANCE) -> DataFrame:
    """Per (index, shard): primary vs each replica, issue list, consistency flag.

    One grouping: the primary on the greatest node by ``max_by``, the replicas as a short
    list (a shard has a handful of copies), and the messages as a transform of that list."""
    g = shard_rows(shards).groupBy("index_name", "shard", "shard_id").agg(
        F.max_by(F.struct("doc_count", "node"), F.when(F.col("prirep") == "p", F.struct("node", "doc_count"))).alias("p"),
        F.max(F.col("prirep") == "p").alias("_has_p"),
        F.sort_array(F.collect_list(F.when(F.col("prirep") != "p", F.struct("node", "state", "docs", "doc_count")))).alias("_r"))
    has_p = F.coalesce("_has_p", F.lit(False))

    def message(r: Column) -> Column:
        diff = F.abs(F.col("p.doc_count") - r["doc_count"])
        return F.when(r["state"] != "STARTED", F.format_string(MSG_NOT_STARTED, r["node"], r["state"])).when(
            has_p & (diff > tolerance), F.format_string(MSG_DOC_MISMATCH, F.col("p.doc_count"), r["node"], r["doc_count"], diff))

    g = g.withColumn("_m", F.filter(F.transform("_r", message), lambda m: m.isNotNull()))
    issues = (F.when(~has_p, F.array(F.format_string(MSG_NO_PRIMARY, F.col("shard"))))
              .when(F.size("_r") == 0, F.concat("_m", F.array(F.format_string(MSG_NO_REPLICA, F.col("shard"))))).otherwise(F.col("_m")))
    return g.select("index_name", "shard", "shard_id", F.when(has_p, F.col("p.node")).alias("primary_node"),
                    F.when(has_p, F.col("p.doc_count")).alias("primary_doc_count"), F.size("_r").cast("long").alias("replica_count"),
                    (has_p & (F.size("_m") == 0)).alias("is_consistent"), issues.alias("issues"))


def index_consistency(shard_reports: DataFrame) -> DataFrame:
    """Per index totals, issues of inconsistent shards (by shard number), status with integer halving."""
    g = shard_reports.groupBy("index_name").agg(
        F.count(F.lit(1)).alias("total_shards"),
        F.count_if("is_consistent").alias("consistent_shards"),
        F.count_if(~F.col("is_consistent")).alias("inconsistent_shards"),
        F.sort_array(F.collect_list(F.when(~F.col("is_consistent"), F.struct("shard_id", "shard", "issues")))).alias("_i"))
    st = (F.when(F.col("inconsistent_shards") == 0, F.lit("consistent"))
          .when(F.col("inconsistent_shards") < F.floor(F.col("total_shards") / 2), F.lit("inconsistent"))
          .otherwise(F.lit("error")))
    return g.select("index_name", "total_shards", "consistent_shards", "inconsistent_shards",
                    F.flatten(F.transform("_i", lambda x: x["issues"])).alias("issues"), st.alias("status"))


def index_issue_rows(shard_reports: DataFrame) -> DataFrame:
    """R7's issue list as rows ``(index_name, shard_id, issue_no, issue)``: the same content
    without gathering an index's issues into one value (for indices with very many shards)."""
    bad = shard_reports.where(~F.col("is_consistent"))
    return bad.select("index_name", "shard_id", F.posexplode("issues").alias("issue_no", "issue")) \
        .withColumn("issue_no", F.col("issue_no") + 1)


def consistency_summary(reports: DataFrame) -> DataFrame:
    """R8."""
    return reports.agg(F.count(F.lit(1)).alias("total"),
                       *[F.count_if(F.col("status") == s).alias(s) for s in ("consistent", "inconsistent", "error")])


def store_size_mismatch(shards: DataFrame) -> DataFrame:
    """STARTED replicas whose store text differs from the primary's (warning only)."""
    s = shard_rows(shards)
    prim = s.where(F.col("prirep") == "p").groupBy("index_name", "shard").agg(
        F.max_by(F.col("store"), F.col("node")).alias("primary_store"))
    reps = s.where((F.col("prirep") != "p") & (F.col("state") == "STARTED"))
    return reps.join(prim, ["index_name", "shard"]).where(F.col("store") != F.col("primary_store")) \
        .select("index_name", "shard", F.col("node").alias("replica_node"), "primary_store",
                F.col("store").alias("replica_store"))


def recovery_candidates(repl: DataFrame, cons: DataFrame, active: DataFrame) -> DataFrame:
    """failed/degraded -> reallocate; inconsistent/error -> resync; skip indices already recovering.

    The replication pass runs first, so an index it queues is recovering by
    the time the consistency pass looks at it.
    """
    busy = active.where(F.col("status").isin(ACTIVE_RECOVERY_STATES)).select("index_name")
    r = repl.where(F.col("status").isin("failed", "degraded")).select(
        "index_name", F.lit("reallocate").alias("action"), F.lit("replication").alias("source"),
        F.when(F.col("status") == "failed",
               F.format_string(MSG_REPL_FAILED, F.bround("replication_progress", 1)))
        .otherwise(F.format_string(MSG_DEGRADED, F.col("unreplicated_shards"))).alias("description"))
    r = r.join(busy, "index_name", "left_anti")
    c = cons.where(F.col("status").isin("inconsistent", "error")).select(
        "index_name", F.lit("resync").alias("action"), F.lit("consistency").alias("source"),
        F.when(F.col("status") == "inconsistent",
               F.format_string(MSG_INCONSISTENT, F.col("inconsistent_shards"), F.col("total_shards")))
        .otherwise(F.format_string(MSG_SEVERE, F.col("inconsistent_shards"), F.col("total_shards"))).alias("description"))
    c = c.join(busy, "index_name", "left_anti").join(r.select("index_name"), "index_name", "left_anti")
    return r.unionByName(c)


def unassigned_count(shards: DataFrame) -> DataFrame:
    """Unassigned shards per index and whether a reallocation would pass."""
    g = shards.groupBy("index_name").agg(F.count_if(F.col("state") == "UNASSIGNED").alias("unassigned"))
    return g.withColumn("reallocation_ok", F.col("unassigned") == 0)


def verification(repl: DataFrame, cons: DataFrame) -> DataFrame:
    """Healthy (or unknown) replication and a consistent index."""
    j = cons.select("index_name", F.col("status").alias("consistency_status")).join(
        repl.select("index_name", F.col("status").alias("replication_status")), "index_name", "left")
    ok = (F.col("replication_status").isNull() | (F.col("replication_status") == "healthy")) & \
         (F.col("consistency_status") == "consistent")
    return j.withColumn("verified", ok)


def recovery_flatten(bodies: DataFrame, body_col: str = "body") -> DataFrame:
    """``{index: {shards: [...]}}`` JSON -> one row per shard recovery; missing keys -> zero values."""
    m = bodies.select(F.from_json(F.col(body_col), RECOVERY_SCHEMA).alias("m"))
    e = m.select(F.explode("m").alias("index_name", "v")).select("index_name", F.explode("v.shards").alias("s"))
    return e.select(
        "index_name",
        F.coalesce("s.id", F.lit(0)).alias("shard"),
        F.coalesce("s.type", F.lit("")).alias("type"),
        F.coalesce("s.stage", F.lit("")).alias("stage"),
        F.coalesce("s.source.name", F.lit("")).alias("source_node"),
        F.coalesce("s.target.name", F.lit("")).alias("target_node"),
        F.coalesce("s.index.size.recovered_in_bytes", F.lit(0)).alias("bytes_recovered"),
        F.coalesce("s.index.size.total_in_bytes", F.lit(0)).alias("bytes_total"),
        F.coalesce("s.index.size.percent", F.lit("")).alias("percent"),
        F.when(F.col("s.start_time_in_millis").isNull(), F.lit("")).otherwise(
            epoch_ms_to_rfc3339(F.col("s.start_time_in_millis"))).alias("start_time"),
    )


def recovery_progress(recoveries: DataFrame) -> DataFrame:
    """Recoveries per index, active (not DONE) count and byte-weighted percent."""
    g = recoveries.groupBy("index_name").agg(
        F.count(F.lit(1)).alias("recoveries"), F.count_if(F.col("stage") != "DONE").alias("active"),
        F.sum("bytes_recovered").alias("bytes_recovered"), F.sum("bytes_total").alias("bytes_total"))
    return g.withColumn("percent", F.round(F.try_divide(F.col("bytes_recovered") * 100.0, F.col("bytes_total")), 6))


def rebalance_flag(shards: DataFrame) -> DataFrame:
    """Shards per node above 5 -> rebalance."""
    g = shards.agg(F.count(F.lit(1)).alias("shard_count"), F.count_distinct("node").alias("node_count"))
    avg = F.try_divide(F.col("shard_count").cast("double"), F.col("node_count"))
    return g.withColumn("shards_per_node", F.round(avg, 6)).withColumn("rebalance", avg > REBALANCE_SHARDS_PER_NODE)
