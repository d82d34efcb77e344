"""R1-R16 over the ``fx_shards`` / ``fx_recovery_json`` fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from quiver.operators import health as H
from quiver.plans.registry import job
from quiver.session import scratch_path
from quiver.sources.fixtures import spark_view, with_views


def v(spark, sf_dir, name):
    return spark_view(spark, sf_dir, name)


INT_RE = "'^\\s*([+-]?[0-9]+)'"
_SR = ("sr", f"SELECT index_name, shard, TRY_CAST(regexp_extract(shard, {INT_RE}, 1) AS BIGINT) AS shard_id, prirep, state, docs, "
             f"coalesce(TRY_CAST(regexp_extract(docs, {INT_RE}, 1) AS BIGINT), 0) AS doc_count, store, node FROM fx_shards")
_PRIM = ("prim", "SELECT index_name, shard, arg_max(doc_count, node) AS p_docs, arg_max(store, node) AS p_store, max(node) AS p_node "
                 "FROM sr WHERE prirep = 'p' GROUP BY index_name, shard")
_REP = ("rep", "SELECT r.index_name, r.shard, r.node, r.state, r.docs, r.store, p.p_store, CASE WHEN r.state <> 'STARTED' THEN "
               "printf('Replica on %s is not STARTED (state: %s)', r.node, r.state) WHEN abs(p.p_docs - r.doc_count) > 10 THEN "
               "printf('Doc count mismatch: primary=%d, replica on %s=%d (diff=%d)', p.p_docs, r.node, r.doc_count, abs(p.p_docs - r.doc_count)) "
               "END AS msg FROM sr r LEFT JOIN prim p ON p.index_name = r.index_name AND p.shard = r.shard WHERE r.prirep <> 'p'")
_RAGG = ("ragg", "SELECT index_name, shard, count(*) AS replica_count, list(msg ORDER BY node, state, docs, msg) FILTER (WHERE msg IS NOT NULL) AS issues, "
                 "bool_or(msg IS NOT NULL) AS bad FROM rep GROUP BY index_name, shard")
_SC = ("sc", "SELECT k.index_name, k.shard, k.shard_id, p.p_node AS primary_node, p.p_docs AS primary_doc_count, "
             "CAST(coalesce(a.replica_count, 0) AS BIGINT) AS replica_count, p.p_node IS NOT NULL AND NOT coalesce(a.bad, false) AS is_consistent, "
             "CASE WHEN p.p_node IS NULL THEN [printf('No primary shard found for shard %s', k.shard)] "
             "WHEN coalesce(a.replica_count, 0) = 0 THEN list_concat(coalesce(a.issues, []::VARCHAR[]), [printf('No replica shards found for shard %s', k.shard)]) "
             "ELSE coalesce(a.issues, []::VARCHAR[]) END AS issues "
             "FROM (SELECT DISTINCT index_name, shard, shard_id FROM sr) k LEFT JOIN prim p ON p.index_name = k.index_name AND p.shard = k.shard "
             "LEFT JOIN ragg a ON a.index_name = k.index_name AND a.shard = k.shard")
_IC = ("ic", "SELECT index_name, CAST(count(*) AS BIGINT) AS total_shards, CAST(count(*) FILTER (WHERE is_consistent) AS BIGINT) AS consistent_shards, "
             "CAST(count(*) FILTER (WHERE NOT is_consistent) AS BIGINT) AS inconsistent_shards, "
             "flatten(coalesce(list(issues ORDER BY shard_id, shard) FILTER (WHERE NOT is_consistent), []::VARCHAR[][])) AS issues, "
             "CASE WHEN count(*) FILTER (WHERE NOT is_consistent) = 0 THEN 'consistent' "
             "WHEN count(*) FILTER (WHERE NOT is_consistent) < count(*) // 2 THEN 'inconsistent' ELSE 'error' END AS status FROM sc GROUP BY index_name")
_RS = ("rs", "SELECT index_name, CAST(count(*) AS BIGINT) AS total_shards, CAST(count(*) FILTER (WHERE state = 'STARTED') AS BIGINT) AS replicated_shards, "
             "CAST(count(*) FILTER (WHERE state <> 'STARTED') AS BIGINT) AS unreplicated_shards, "
             "count(*) FILTER (WHERE state = 'STARTED') / count(*) * 100.0 AS replication_progress, "
             "CASE WHEN count(*) FILTER (WHERE state <> 'STARTED') = 0 THEN 'healthy' "
             "WHEN count(*) FILTER (WHERE state = 'STARTED') / count(*) * 100.0 < 50 THEN 'failed' ELSE 'syncing' END AS status "
             "FROM fx_shards GROUP BY index_name")
_HV = ["fx_shards"]
_HC = [_SR, _PRIM, _REP, _RAGG, _SC, _IC, _RS]


def shards(spark, sf_dir):
    return v(spark, sf_dir, "fx_shards")


@job("R1_shard_rows", with_views(
    "SELECT index_name, shard, shard_id, prirep, state, docs, doc_count, store, node FROM sr", _HV, [_SR]), "health")
def r1(spark, sf_dir):
    """Shard rows written as JSON lines, read back with a fixed schema and typed."""
    path = scratch_path(spark, "shards-json")
    shards(spark, sf_dir).write.mode("overwrite").json(path)
    raw = spark.read.schema(H.SHARD_SCHEMA).json(path)
    return H.shard_rows(raw)


@job("R2_replication_status", with_views(
    "SELECT index_name, total_shards, replicated_shards, unreplicated_shards, round(replication_progress, 6) AS replication_progress, status FROM rs",
    _HV, [_RS]), "health")
def r2(spark, sf_dir):
    s = H.replication_status(shards(spark, sf_dir))
    return s.withColumn("replication_progress", F.round("replication_progress", 6))


@job("R3_replication_summary", with_views(
    "SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE status = 'healthy') AS BIGINT) AS healthy, "
    "CAST(count(*) FILTER (WHERE status = 'syncing') AS BIGINT) AS syncing, CAST(count(*) FILTER (WHERE status = 'degraded') AS BIGINT) AS degraded, "
    "CAST(count(*) FILTER (WHERE status = 'failed') AS BIGINT) AS failed FROM rs", _HV, [_RS]), "health")
def r3(spark, sf_dir):
    return H.replication_summary(H.replication_status(shards(spark, sf_dir)))


@job("R4_stuck_shards", with_views(
    "SELECT s.index_name, coalesce(list(shard_id ORDER BY shard_id) FILTER (WHERE state = 'UNASSIGNED'), []::BIGINT[]) AS unassigned_shards, "
    "coalesce(list(shard_id ORDER BY shard_id) FILTER (WHERE state = 'INITIALIZING'), []::BIGINT[]) AS initializing_shards "
    "FROM sr s JOIN rs r ON r.index_name = s.index_name WHERE r.status = 'failed' GROUP BY s.index_name", _HV, [_SR, _RS]), "health")
def r4(spark, sf_dir):
    s = shards(spark, sf_dir)
    return H.stuck_shards(s, H.replication_status(s))


@job("R6_shard_consistency", with_views("SELECT * FROM sc", _HV, _HC[:5]), "health")
def r6(spark, sf_dir):
    return H.shard_consistency(shards(spark, sf_dir))


@job("R7_index_consistency", with_views("SELECT * FROM ic", _HV, _HC[:6]), "health")
def r7(spark, sf_dir):
    return H.index_consistency(H.shard_consistency(shards(spark, sf_dir)))


@job("R7_index_issue_rows", with_views(
    "SELECT index_name, shard_id, CAST(generate_subscripts(issues, 1) AS BIGINT) AS issue_no, unnest(issues) AS issue "
    "FROM sc WHERE NOT is_consistent", _HV, _HC[:5]), "health")
def r7rows(spark, sf_dir):
    return H.index_issue_rows(H.shard_consistency(shards(spark, sf_dir)))


@job("R8_consistency_summary", with_views(
    "SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE status = 'consistent') AS BIGINT) AS consistent, "
    "CAST(count(*) FILTER (WHERE status = 'inconsistent') AS BIGINT) AS inconsistent, "
    "CAST(count(*) FILTER (WHERE status = 'error') AS BIGINT) AS error FROM ic", _HV, _HC[:6]), "health")
def r8(spark, sf_dir):
    return H.consistency_summary(H.index_consistency(H.shard_consistency(shards(spark, sf_dir))))


@job("R10_store_size_mismatch", with_views(
    "SELECT index_name, shard, node AS replica_node, p_store AS primary_store, store AS replica_store FROM rep "
    "WHERE state = 'STARTED' AND store <> p_store", _HV, [_SR, _PRIM, _REP]), "health")
def r10(spark, sf_dir):
    return H.store_size_mismatch(shards(spark, sf_dir))


_ACTIVE = ("act", "SELECT index_name, 'running' AS status FROM fx_index_metadata WHERE status = 'building'")


def active_recoveries(spark, sf_dir):
    return v(spark, sf_dir, "fx_index_metadata").where("status = 'building'").select("index_name", F.lit("running").alias("status"))


@job("R11_recovery_candidates", with_views(
    "SELECT * FROM rc", _HV + ["fx_index_metadata"], _HC + [_ACTIVE, (
        "rr", "SELECT index_name, 'reallocate' AS action, 'replication' AS source, CASE WHEN status = 'failed' THEN "
              "printf('Replication failed: %.1f%% complete', round_even(replication_progress, 1)) ELSE printf('Degraded: %d unassigned shards', unreplicated_shards) END "
              "AS description FROM rs WHERE status IN ('failed', 'degraded') AND index_name NOT IN (SELECT index_name FROM act)"), (
        "rc", "SELECT * FROM rr UNION ALL SELECT index_name, 'resync', 'consistency', CASE WHEN status = 'inconsistent' THEN "
              "printf('Inconsistent: %d/%d shards', inconsistent_shards, total_shards) ELSE printf('Severe: %d/%d shards inconsistent', inconsistent_shards, total_shards) END "
              "FROM ic WHERE status IN ('inconsistent', 'error') AND index_name NOT IN (SELECT index_name FROM act) AND index_name NOT IN (SELECT index_name FROM rr)")]
), "health")
def r11(spark, sf_dir):
    s = shards(spark, sf_dir)
    return H.recovery_candidates(H.replication_status(s), H.index_consistency(H.shard_consistency(s)),
                                 active_recoveries(spark, sf_dir))


@job("R12_unassigned_count", with_views(
    "SELECT index_name, CAST(count(*) FILTER (WHERE state = 'UNASSIGNED') AS BIGINT) AS unassigned, "
    "count(*) FILTER (WHERE state = 'UNASSIGNED') = 0 AS reallocation_ok FROM fx_shards GROUP BY index_name", _HV), "health")
def r12(spark, sf_dir):
    return H.unassigned_count(shards(spark, sf_dir))


@job("R13_verification", with_views(
    "SELECT i.index_name, i.status AS consistency_status, r.status AS replication_status, "
    "(r.status IS NULL OR r.status = 'healthy') AND i.status = 'consistent' AS verified FROM ic i LEFT JOIN rs r ON r.index_name = i.index_name",
    _HV, _HC), "health")
def r13(spark, sf_dir):
    s = shards(spark, sf_dir)
    return H.verification(H.replication_status(s), H.index_consistency(H.shard_consistency(s)))


_RF = ("rf", "SELECT a.k AS index_name, coalesce(CAST(json_extract(b.s, '$.id') AS BIGINT), 0) AS shard, "
             "coalesce(json_extract_string(b.s, '$.type'), '') AS type, coalesce(json_extract_string(b.s, '$.stage'), '') AS stage, "
             "coalesce(json_extract_string(b.s, '$.source.name'), '') AS source_node, coalesce(json_extract_string(b.s, '$.target.name'), '') AS target_node, "
             "coalesce(CAST(json_extract(b.s, '$.index.size.recovered_in_bytes') AS BIGINT), 0) AS bytes_recovered, "
             "coalesce(CAST(json_extract(b.s, '$.index.size.total_in_bytes') AS BIGINT), 0) AS bytes_total, "
             "coalesce(json_extract_string(b.s, '$.index.size.percent'), '') AS percent, "
             "CASE WHEN json_extract(b.s, '$.start_time_in_millis') IS NULL THEN '' ELSE strftime(make_timestamp("
             "(CAST(json_extract(b.s, '$.start_time_in_millis') AS BIGINT) // 1000) * 1000000), '%Y-%m-%dT%H:%M:%SZ') END AS start_time "
             "FROM (SELECT body, unnest(json_keys(body)) AS k FROM fx_recovery_json) a, "
             "LATERAL (SELECT unnest(CAST(json_extract(a.body, '$.\"' || a.k || '\".shards') AS JSON[])) AS s) b")


@job("R14_recovery_flatten", with_views("SELECT * FROM rf", ["fx_recovery_json"], [_RF]), "health")
def r14(spark, sf_dir):
    return H.recovery_flatten(v(spark, sf_dir, "fx_recovery_json"))


@job("R15_recovery_progress", with_views(
    "SELECT index_name, CAST(count(*) AS BIGINT) AS recoveries, CAST(count(*) FILTER (WHERE stage <> 'DONE') AS BIGINT) AS active, "
    "CAST(sum(bytes_recovered) AS BIGINT) AS bytes_recovered, CAST(sum(bytes_total) AS BIGINT) AS bytes_total, "
    "round(CASE WHEN sum(bytes_total) = 0 THEN NULL ELSE sum(bytes_recovered) * 100.0 / sum(bytes_total) END, 6) AS percent FROM rf GROUP BY index_name",
    ["fx_recovery_json"], [_RF]), "health")
def r15(spark, sf_dir):
    return H.recovery_progress(H.recovery_flatten(v(spark, sf_dir, "fx_recovery_json")))


@job("R16_rebalance_flag", with_views(
    "SELECT CAST(count(*) AS BIGINT) AS shard_count, CAST(count(DISTINCT node) AS BIGINT) AS node_count, "
    "round(count(*) / count(DISTINCT node), 6) AS shards_per_node, count(*) / count(DISTINCT node) > 5 AS rebalance FROM fx_shards", _HV), "health")
def r16(spark, sf_dir):
    return H.rebalance_flag(shards(spark, sf_dir))
