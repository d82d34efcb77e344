"""T1-T16 and S5 over the fixture views of tenants, deployments, quotas."""

from __future__ import annotations

from pyspark.sql import functions as F

from quiver.functions.text import parse_cpu, parse_memory_mib, parse_percent
from quiver.operators import tenants as T
from quiver.plans import sqlx
from quiver.plans.registry import job
from quiver.sources.fixtures import spark_view, with_views
from quiver.sources.tables import table


def v(spark, sf_dir, name):
    return spark_view(spark, sf_dir, name)


@job("T1_containers_by_org", with_views(
    "SELECT id, tenant_org_id, user_id, service_name, namespace, CAST(replicas AS BIGINT) AS replicas FROM fx_tenant_containers "
    "WHERE NOT deleted AND tenant_org_id IN (SELECT concat('org-', CAST(n_nationkey AS VARCHAR)) FROM nation WHERE n_regionkey = 1)",
    ["fx_tenant_containers"]), "tenant")
def t1(spark, sf_dir):
    orgs = table(spark, sf_dir, "nation").where("n_regionkey = 1") \
        .select(F.concat(F.lit("org-"), F.col("n_nationkey").cast("string")).alias("tenant_org_id"))
    c = T.containers_by_org(v(spark, sf_dir, "fx_tenant_containers"), orgs)
    return c.select("id", "tenant_org_id", "user_id", "service_name", "namespace", "replicas")


_KEYS_SQL = ("SELECT DISTINCT concat('user-', CAST(o_custkey % 200 AS VARCHAR)) AS user_id, "
             "concat('svc-', CAST(o_custkey + (o_orderkey % 2) * 7 AS VARCHAR)) AS service_name FROM orders")


@job("T2_key_lookup", with_views(
    "SELECT k.user_id, k.service_name, c.id, c.namespace, c.deleted, c.id IS NOT NULL AS found FROM keys k "
    "LEFT JOIN fx_tenant_containers c ON c.user_id = k.user_id AND c.service_name = k.service_name",
    ["fx_tenant_containers"], [("keys", _KEYS_SQL)]), "tenant")
def t2(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    keys = o.select(F.concat(F.lit("user-"), (F.col("o_custkey") % 200).cast("string")).alias("user_id"),
                    F.concat(F.lit("svc-"), (F.col("o_custkey") + (F.col("o_orderkey") % 2) * 7).cast("string")).alias("service_name")).distinct()
    c = v(spark, sf_dir, "fx_tenant_containers").select("user_id", "service_name", "id", "namespace", "deleted")
    return T.key_lookup(keys, c, ["user_id", "service_name"])


@job("T2_key_lookup_index", with_views(
    "SELECT k.id, m.index_name, m.metric, m.id IS NOT NULL AS found FROM "
    "(SELECT DISTINCT l_partkey * 2 AS id FROM lineitem WHERE l_returnflag = 'R') k LEFT JOIN fx_index_metadata m ON m.id = k.id",
    ["fx_index_metadata"]), "tenant")
def t2b(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select((F.col("l_partkey") * 2).alias("id")).distinct()
    m = v(spark, sf_dir, "fx_index_metadata").select("id", "index_name", "metric")
    return T.key_lookup(keys, m, ["id"])


def _delete_requests(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    return e.select(F.concat(F.lit("user-"), ((F.col("user_id") + 1) % 200).cast("string")).alias("user_id"),
                    F.concat(F.lit("svc-"), (F.col("user_id") + 1).cast("string")).alias("service_name"),
                    F.col("ts").alias("requested_at"))


@job("T3_container_soft_delete", with_views(
    "SELECT c.id, c.user_id, c.service_name, c.deleted OR r.del_at IS NOT NULL AS deleted, r.del_at AS deleted_at "
    "FROM fx_tenant_containers c LEFT JOIN (SELECT concat('user-', CAST((user_id + 1) % 200 AS VARCHAR)) AS user_id, "
    "concat('svc-', CAST(user_id + 1 AS VARCHAR)) AS service_name, max(ts) AS del_at FROM events WHERE event_type = 'error' GROUP BY 1, 2) r "
    "ON r.user_id = c.user_id AND r.service_name = c.service_name", ["fx_tenant_containers"]), "tenant")
def t3(spark, sf_dir):
    c = v(spark, sf_dir, "fx_tenant_containers").select("id", "user_id", "service_name", "deleted")
    return T.soft_delete(c, _delete_requests(spark, sf_dir), ["user_id", "service_name"]) \
        .select("id", "user_id", "service_name", "deleted", "deleted_at")


@job("T4_row_upsert", with_views(
    "SELECT user_id, service_name, CAST(replicas AS BIGINT) AS replicas, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id, service_name "
    "ORDER BY updated_at DESC NULLS LAST, event_id DESC NULLS LAST) AS r FROM ("
    "SELECT user_id, service_name, replicas, TIMESTAMP '2023-12-31 00:00:00' AS updated_at, CAST(NULL AS BIGINT) AS event_id FROM fx_tenant_containers "
    "UNION ALL SELECT concat('user-', CAST((user_id + 1) % 200 AS VARCHAR)), concat('svc-', CAST(user_id + 1 AS VARCHAR)), "
    "CAST(1 + event_id % 7 AS INTEGER), ts, event_id FROM events WHERE event_type = 'purchase') u) t WHERE r = 1",
    ["fx_tenant_containers"]), "tenant")
def t4(spark, sf_dir):
    base = v(spark, sf_dir, "fx_tenant_containers").select(
        "user_id", "service_name", "replicas", F.lit("2023-12-31 00:00:00").cast("timestamp_ntz").alias("updated_at"),
        F.lit(None).cast("long").alias("event_id"))
    ch = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(
        F.concat(F.lit("user-"), ((F.col("user_id") + 1) % 200).cast("string")).alias("user_id"),
        F.concat(F.lit("svc-"), (F.col("user_id") + 1).cast("string")).alias("service_name"),
        (1 + F.col("event_id") % 7).cast("int").alias("replicas"), F.col("ts").alias("updated_at"), "event_id")
    return T.upsert(base, ch, ["user_id", "service_name"], ["updated_at", "event_id"]) \
        .select("user_id", "service_name", "replicas", "updated_at")


@job("T6_cluster_listing", with_views(
    "SELECT d.namespace, d.user_id, d.service_name, coalesce(CAST(r.ready AS VARCHAR) || '/' || CAST(r.desired AS VARCHAR), 'unknown') AS status, "
    "CAST(d.replicas AS BIGINT) AS replicas FROM fx_deployments d LEFT JOIN fx_replicas r ON r.namespace = d.namespace",
    ["fx_deployments", "fx_replicas"]), "tenant")
def t6(spark, sf_dir):
    return T.cluster_listing(v(spark, sf_dir, "fx_deployments"), v(spark, sf_dir, "fx_replicas"))


_REQ_NS_SQL = ("SELECT namespace FROM fx_deployments WHERE replicas = 3 UNION SELECT concat('org-', CAST(s_nationkey AS VARCHAR), "
               "'-user-', CAST(s_suppkey % 200 AS VARCHAR), '-svc-', CAST(s_suppkey AS VARCHAR)) FROM supplier")


@job("T7_cluster_details", with_views(
    "SELECT q.namespace, coalesce(d.user_id, 'unknown') AS user_id, coalesce(d.service_name, 'unknown') AS service_name, "
    "coalesce(d.status, 'unknown') AS status, CAST(coalesce(d.replicas, 1) AS BIGINT) AS replicas, CAST(128 AS BIGINT) AS dimension, "
    "CAST(10000 AS BIGINT) AS vector_count, d.namespace IS NOT NULL AS found FROM req q LEFT JOIN fx_deployments d ON d.namespace = q.namespace",
    ["fx_deployments"], [("req", _REQ_NS_SQL)]), "tenant")
def t7(spark, sf_dir):
    d = v(spark, sf_dir, "fx_deployments")
    s = table(spark, sf_dir, "supplier")
    req = d.where("replicas = 3").select("namespace").union(s.select(F.concat(
        F.lit("org-"), F.col("s_nationkey").cast("string"), F.lit("-user-"), (F.col("s_suppkey") % 200).cast("string"),
        F.lit("-svc-"), F.col("s_suppkey").cast("string")).alias("namespace"))).distinct()
    return T.cluster_details(req, d)


@job("T8_index_list", with_views(
    "SELECT id, index_name, namespace, metric, CAST(document_count AS BIGINT) AS document_count, 'active' AS listing_status FROM fx_index_metadata",
    ["fx_index_metadata"]), "tenant")
def t8(spark, sf_dir):
    return T.index_list(v(spark, sf_dir, "fx_index_metadata"))


@job("T10_delete_by_keys", with_views(
    "SELECT id, index_name, namespace, metric, status, CAST(document_count AS BIGINT) AS document_count FROM fx_index_metadata m "
    "WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = m.id AND l.l_discount >= 0.09)",
    ["fx_index_metadata"]), "tenant")
def t10(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem").where("l_discount >= 0.09").select(F.col("l_partkey").alias("id"))
    return T.delete_by_keys(v(spark, sf_dir, "fx_index_metadata"), keys, ["id"])


@job("T10_delete_policies", with_views(
    "SELECT user_id, CAST(max_replicas AS BIGINT) AS max_replicas FROM fx_policies p WHERE NOT EXISTS (SELECT 1 FROM fx_ns_deployments d WHERE d.user_id = p.user_id)",
    ["fx_policies", "fx_ns_deployments"]), "tenant")
def t10b(spark, sf_dir):
    """Remove the scaling policies of users that own a namespace deployment."""
    keys = v(spark, sf_dir, "fx_ns_deployments").select("user_id")
    return T.delete_by_keys(v(spark, sf_dir, "fx_policies"), keys, ["user_id"]).select("user_id", "max_replicas")


@job("T11_quota_check", with_views(
    "SELECT t.tenant_id, CAST(coalesce(q.max_indices, 100) AS BIGINT) AS max_indices, '1Ti' AS max_storage, "
    "CAST(coalesce(q.current_indices, 0) AS BIGINT) AS current_indices, '0Gi' AS current_storage, q.tenant_id IS NOT NULL AS has_quota_row, "
    "coalesce(q.current_indices, 0) < coalesce(q.max_indices, 100) AS allowed "
    "FROM (SELECT DISTINCT user_id AS tenant_id FROM fx_tenant_containers) t LEFT JOIN fx_tenant_quota q ON q.tenant_id = t.tenant_id",
    ["fx_tenant_containers", "fx_tenant_quota"]), "tenant")
def t11(spark, sf_dir):
    tenants = v(spark, sf_dir, "fx_tenant_containers").select(F.col("user_id").alias("tenant_id"))
    return T.quota_check(tenants, v(spark, sf_dir, "fx_tenant_quota"))


@job("T12_quota_usage_apply", with_views(
    "SELECT coalesce(q.tenant_id, d.tenant_id) AS tenant_id, CAST(coalesce(q.max_indices, 100) AS BIGINT) AS max_indices, "
    "'1Ti' AS max_storage, CAST(coalesce(q.current_indices, 0) + coalesce(d.delta, 0) AS BIGINT) AS current_indices, "
    "'0Gi' AS current_storage FROM fx_tenant_quota q FULL OUTER JOIN (SELECT tenant_id, "
    "sum(CASE WHEN increase THEN 1 ELSE -1 END) AS delta FROM fx_quota_events GROUP BY tenant_id) d ON d.tenant_id = q.tenant_id",
    ["fx_tenant_quota", "fx_quota_events"]), "tenant")
def t12(spark, sf_dir):
    return T.quota_usage_apply(v(spark, sf_dir, "fx_tenant_quota"), v(spark, sf_dir, "fx_quota_events"))


def _gi_sql(c, default):
    x = f"(CASE WHEN {c} IS NULL OR {c} = '' THEN '{default}' ELSE {c} END)"
    return f"(CASE WHEN regexp_matches({x}, '^[+-]?[0-9]+$') THEN {x} || 'Gi' ELSE {x} END)"


@job("T14_request_normalise", with_views(
    "SELECT id, tenant_org_id, user_id, service_name, "
    "CASE WHEN namespace = '' THEN concat_ws('-', tenant_org_id, user_id, service_name) ELSE namespace END AS namespace, "
    "CAST(CASE WHEN replicas <= 0 THEN 1 ELSE replicas END AS BIGINT) AS replicas, CASE WHEN cpu = '' THEN '500m' ELSE cpu END AS cpu, "
    f"{_gi_sql('memory', '1Gi')} AS memory, {_gi_sql('disk', '10Gi')} AS disk, "
    "CAST(CASE WHEN dimension <= 0 THEN 128 ELSE dimension END AS BIGINT) AS dimension, CAST(10000 AS BIGINT) AS vector_count, "
    "CASE WHEN tenant_org_id = '' THEN 'tenant_org_id is required for multi-tenancy' WHEN user_id = '' THEN 'user is required' "
    "WHEN service_name = '' THEN 'service_name is required' END AS reject_reason FROM fx_requests", ["fx_requests"]), "tenant")
def t14(spark, sf_dir):
    return T.request_normalise(v(spark, sf_dir, "fx_requests"))


_WIDE_SQL = (f"SELECT p.id, p.namespace, round({sqlx.cpu_cores()}, 6) AS cpu_usage, round({sqlx.memory_mib()}, 6) AS memory_usage, "
             f"round({sqlx.percent()}, 6) AS disk_usage, m.qps, p.ts FROM fx_pod_usage p JOIN fx_metrics m ON m.id = p.id")


def wide_container_metrics(spark, sf_dir):
    p = v(spark, sf_dir, "fx_pod_usage")
    m = v(spark, sf_dir, "fx_metrics").select("id", "qps")
    return p.select("id", "namespace", F.round(parse_cpu("cpu_text"), 6).alias("cpu_usage"),
                    F.round(parse_memory_mib("mem_text"), 6).alias("memory_usage"),
                    F.round(parse_percent("disk_text"), 6).alias("disk_usage"), "ts").join(m, "id")


@job("T15_container_metrics_project", with_views(
    "SELECT id, namespace, cpu_usage, memory_usage, disk_usage, qps, ts AS timestamp FROM wide",
    ["fx_pod_usage", "fx_metrics"], [("wide", _WIDE_SQL)]), "tenant")
def t15(spark, sf_dir):
    return T.container_metrics_project(wide_container_metrics(spark, sf_dir))


LATENCY_ACCURACY = 100000


def latency_by_namespace(spark, sf_dir):
    log = v(spark, sf_dir, "fx_search_log")
    meta = v(spark, sf_dir, "fx_index_metadata").select("index_name", "namespace")
    j = log.join(meta, "index_name")
    return j.groupBy("namespace").agg(
        F.count(F.lit(1)).alias("searches"),
        F.round(F.avg("latency_ms"), 6).alias("avg_latency"),
        F.percentile_approx("latency_ms", 0.95, LATENCY_ACCURACY).alias("p95_latency"),
        F.percentile_approx("latency_ms", 0.99, LATENCY_ACCURACY).alias("p99_latency"))


@job("T16_qps_view", with_views(
    "SELECT m.namespace, m.id, m.qps, m.ts AS timestamp, l.searches, l.avg_latency, l.p95_latency, l.p99_latency FROM "
    "(SELECT namespace, arg_max(id, (ts, id)) AS id, arg_max(qps, (ts, id)) AS qps, max(ts) AS ts FROM fx_metrics GROUP BY namespace) m "
    "LEFT JOIN (SELECT i.namespace, CAST(count(*) AS BIGINT) AS searches, round(avg(s.latency_ms), 6) AS avg_latency, "
    "quantile_disc(s.latency_ms, 0.95) AS p95_latency, quantile_disc(s.latency_ms, 0.99) AS p99_latency "
    "FROM fx_search_log s JOIN fx_index_metadata i ON i.index_name = s.index_name GROUP BY i.namespace) l ON l.namespace = m.namespace",
    ["fx_metrics", "fx_search_log", "fx_index_metadata"]), "tenant")
def t16(spark, sf_dir):
    return T.qps_view(v(spark, sf_dir, "fx_metrics"), latency_by_namespace(spark, sf_dir))


_DOC_CHANGES = ("SELECT CAST(doc_id AS VARCHAR) AS doc_id, upper(lang) AS lang, source, n_chars + 1 AS n_chars, 2 AS version "
                "FROM documents WHERE source = 'web'")


@job("S5_document_upsert", with_views(
    "SELECT doc_id, lang, source, n_chars, CAST(version AS BIGINT) AS version FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY version DESC) AS r FROM ("
    "SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source, n_chars, 1 AS version FROM documents UNION ALL " + _DOC_CHANGES + ") u) t WHERE r = 1"),
    "tenant")
def s5(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    base = d.select("doc_id", "lang", "source", "n_chars", F.lit(1).alias("version"))
    ch = d.where("source = 'web'").select("doc_id", F.upper("lang").alias("lang"), "source",
                                           (F.col("n_chars") + 1).alias("n_chars"), F.lit(2).alias("version"))
    return T.document_upsert(base, ch)
