"""A1-A9, U1-U5, M1-M16 over the metric / report / search-log fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from quiver.functions import text as U
from quiver.operators import reports as A
from quiver.operators import scaling as M
from quiver.operators.scaler_chunks import scaling_scan_chunked
from quiver.operators.tenants import quota_check
from quiver.plans import sqlx
from quiver.plans.registry import job
from quiver.sources.fixtures import spark_view, with_views
from quiver.sources.tables import table


def v(spark, sf_dir, name):
    return spark_view(spark, sf_dir, name)


sql_float = sqlx.leading_float
sql_strip = sqlx.strip_suffix
_MEM_FACTOR = sqlx.MEM_FACTOR


# ------------------------------------------------------------------ U


@job("U1_parse_cpu", with_views(
    f"SELECT id, cpu_text, round(coalesce({sql_float(sql_strip('cpu_text', 'm'))}, 0) / 1000.0, 6) AS cpu_cores, "
    f"round(CASE WHEN suffix(cpu_text, 'm') THEN coalesce({sql_float(sql_strip('cpu_text', 'm'))}, 0) / 1000.0 "
    f"ELSE coalesce({sql_float('cpu_text')}, 0) END, 6) AS cpu_cores_strict FROM fx_pod_usage", ["fx_pod_usage"]), "text")
def u1(spark, sf_dir):
    p = v(spark, sf_dir, "fx_pod_usage")
    return p.select("id", "cpu_text", F.round(U.parse_cpu("cpu_text"), 6).alias("cpu_cores"),
                    F.round(U.parse_cpu("cpu_text", strict=True), 6).alias("cpu_cores_strict"))



@job("U2_parse_memory_mib", with_views(
    f"SELECT id, mem_text, round(coalesce({sql_float('mem_text')} * {_MEM_FACTOR}, 0), 6) AS memory_mib, "
    f"round(coalesce({sql_float(sql_strip('mem_text', 'Mi'))}, 0), 6) AS memory_mib_parity "
    "FROM fx_pod_usage", ["fx_pod_usage"]), "text")
def u2(spark, sf_dir):
    p = v(spark, sf_dir, "fx_pod_usage")
    return p.select("id", "mem_text", F.round(U.parse_memory_mib("mem_text"), 6).alias("memory_mib"),
                    F.round(U.parse_memory_mib("mem_text", parity=True), 6).alias("memory_mib_parity"))


@job("U3_parse_percent", with_views(
    f"SELECT id, disk_text, round(coalesce({sql_float(sql_strip('disk_text', '%'))}, 0), 6) AS disk_pct "
    "FROM fx_pod_usage", ["fx_pod_usage"]), "text")
def u3(spark, sf_dir):
    p = v(spark, sf_dir, "fx_pod_usage")
    return p.select("id", "disk_text", F.round(U.parse_percent("disk_text"), 6).alias("disk_pct"))


@job("U4_parse_doc_count", with_views(
    "SELECT index_name, shard, prirep, node, docs, CAST(coalesce(TRY_CAST(regexp_extract(docs, '^\\s*([+-]?[0-9]+)', 1) AS BIGINT), 0) AS BIGINT) AS doc_count "
    "FROM fx_shards", ["fx_shards"]), "text")
def u4(spark, sf_dir):
    s = v(spark, sf_dir, "fx_shards")
    return s.select("index_name", "shard", "prirep", "node", "docs", U.parse_doc_count("docs").alias("doc_count"))


@job("U5_epoch_ms_to_rfc3339", with_views(
    "SELECT p_partkey AS id, 1704067200000 + p_partkey * 61001 AS start_ms, "
    "strftime(make_timestamp(((1704067200000 + p_partkey * 61001) // 1000) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS start_time FROM part"), "text")
def u5(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"),
                                             (F.lit(1704067200000) + F.col("p_partkey") * 61001).alias("start_ms"))
    return p.withColumn("start_time", U.epoch_ms_to_rfc3339("start_ms"))


# ------------------------------------------------------------------ A


@job("A1_latest_metrics", with_views(
    "SELECT namespace, arg_max(id, (ts, id)) AS id, arg_max(cpu_usage, (ts, id)) AS cpu_usage, arg_max(memory_usage, (ts, id)) AS memory_usage, "
    "arg_max(disk_usage, (ts, id)) AS disk_usage, arg_max(qps, (ts, id)) AS qps, max(ts) AS ts FROM fx_metrics GROUP BY namespace",
    ["fx_metrics"]), "report")
def a1(spark, sf_dir):
    return A.latest_metrics(v(spark, sf_dir, "fx_metrics"))


def report_rows(spark, sf_dir):
    """Report rows with an RFC3339 time text; one status in eleven carries an unparsable time."""
    r = v(spark, sf_dir, "fx_reports")
    return r.withColumn("report_time", F.when(F.col("status") == "other", F.lit("not-a-time"))
                        .otherwise(F.date_format("ts", A.RFC3339_PATTERN))) \
        .withColumn("message", F.when(F.col("status") == "other", F.lit(None).cast("string"))
                    .otherwise(F.concat(F.lit("stage "), F.col("status"))))


_REPORT_ROWS_SQL = ("SELECT *, CASE WHEN status = 'other' THEN 'not-a-time' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS report_time, "
                    "CASE WHEN status = 'other' THEN NULL ELSE 'stage ' || status END AS message FROM fx_reports")


@job("A2_latest_report", with_views(
    "SELECT user_id, service_name, arg_max(id, (t, id)) AS id, arg_max(status, (t, id)) AS status, "
    "arg_max(report_time, (t, id)) AS report_time FROM (SELECT *, try_strptime(report_time, '%Y-%m-%dT%H:%M:%SZ') AS t FROM rr) x "
    "WHERE t IS NOT NULL GROUP BY user_id, service_name", ["fx_reports"], [("rr", _REPORT_ROWS_SQL)]), "report")
def a2(spark, sf_dir):
    r = report_rows(spark, sf_dir).select("id", "user_id", "service_name", "status", "report_time")
    return A.latest_report(r)


@job("A4_report_status_counts", with_views(
    "SELECT CAST(s.stage_order AS BIGINT) AS stage_order, s.status, CAST(coalesce(c.n, 0) AS BIGINT) AS reports FROM (VALUES " +
    ", ".join(f"({i}, '{s}')" for i, s in enumerate(A.REPORT_STAGES)) +
    ") s(stage_order, status) LEFT JOIN (SELECT status, count(*) AS n FROM fx_reports GROUP BY status) c ON c.status = s.status",
    ["fx_reports"]), "report")
def a4(spark, sf_dir):
    return A.report_status_counts(v(spark, sf_dir, "fx_reports"))


@job("A5_report_history", with_views(
    "SELECT user_id, service_name, id, status, coalesce(message, 'N/A') AS message, ts, "
    "row_number() OVER (PARTITION BY user_id, service_name ORDER BY ts DESC, id DESC) AS position FROM rr",
    ["fx_reports"], [("rr", _REPORT_ROWS_SQL)]), "report")
def a5(spark, sf_dir):
    r = report_rows(spark, sf_dir).select("user_id", "service_name", "id", "status", "message", "ts")
    return A.report_history(r, ["message"])


_DOC_INDEX = "concat('idx-', CAST(doc_id % 20 + 1 AS VARCHAR))"


@job("A6_index_stats_report", with_views(
    "SELECT d.index_name, d.doc_count, d.size_chars, m.namespace, m.metric, m.status, CAST(m.document_count AS BIGINT) AS document_count FROM ("
    f"SELECT {_DOC_INDEX} AS index_name, CAST(count(*) AS BIGINT) AS doc_count, CAST(sum(n_chars) AS BIGINT) AS size_chars "
    "FROM documents GROUP BY 1) d LEFT JOIN fx_index_metadata m ON m.index_name = d.index_name", ["fx_index_metadata"]), "report")
def a6(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("idx-"), (F.col("doc_id") % 20 + 1).cast("string")).alias("index_name"), "n_chars")
    m = v(spark, sf_dir, "fx_index_metadata").select("index_name", "namespace", "metric", "status", "document_count")
    return A.index_stats_report(d, m)


@job("A7_qps_latency_stats", with_views(
    "SELECT index_name, time_bucket(INTERVAL '60 seconds', ts) AS window_start, CAST(count(*) AS BIGINT) AS queries, "
    "round(count(*) / 60.0, 6) AS qps, round(avg(latency_ms), 6) AS avg_latency, quantile_disc(latency_ms, 0.95) AS p95_latency, "
    "quantile_disc(latency_ms, 0.99) AS p99_latency FROM fx_search_log GROUP BY 1, 2", ["fx_search_log"]), "report")
def a7(spark, sf_dir):
    return A.qps_latency_stats(v(spark, sf_dir, "fx_search_log"))


@job("A8_lifecycle_events", with_views(
    "SELECT coalesce(o.index_name, n.index_name) AS index_name, CASE WHEN o.index_name IS NULL THEN 'index_created' ELSE 'index_deleted' END AS event_type "
    "FROM (SELECT index_name FROM fx_index_metadata WHERE document_count <= 40) o FULL OUTER JOIN "
    "(SELECT index_name FROM fx_index_metadata WHERE document_count >= 10) n ON n.index_name = o.index_name "
    "WHERE o.index_name IS NULL OR n.index_name IS NULL", ["fx_index_metadata"]), "report")
def a8(spark, sf_dir):
    m = v(spark, sf_dir, "fx_index_metadata")
    return A.lifecycle_events(m.where("document_count <= 40"), m.where("document_count >= 10"))


_POD_PARSED = (f"SELECT id, namespace, pod, ts, {sqlx.cpu_cores()} AS cpu_cores, {sqlx.memory_mib()} AS memory_mib, "
               f"{sqlx.percent()} AS disk_pct FROM fx_pod_usage")


@job("A9_fleet_usage", with_views(
    "SELECT namespace, CAST(count(*) AS BIGINT) AS pods, round(sum(cpu_cores), 6) AS cpu_cores, round(sum(memory_mib), 6) AS memory_mib, "
    "round(avg(disk_pct), 6) AS disk_pct FROM (SELECT namespace, pod, arg_max(cpu_cores, (ts, id)) AS cpu_cores, "
    "arg_max(memory_mib, (ts, id)) AS memory_mib, arg_max(disk_pct, (ts, id)) AS disk_pct FROM pp GROUP BY namespace, pod) l GROUP BY namespace",
    ["fx_pod_usage"], [("pp", _POD_PARSED)]), "report")
def a9(spark, sf_dir):
    return A.fleet_usage(v(spark, sf_dir, "fx_pod_usage"))


# ------------------------------------------------------------------ M

_W = "WINDOW w AS (PARTITION BY namespace ORDER BY ts, id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"


def _trend_sql(m):
    return f"CASE WHEN count(*) OVER w < 2 THEN 0.0 ELSE ({m} - first_value({m}) OVER w) / (count(*) OVER w - 1) END"


_TREND_CTE = ("tr", "SELECT *, " + ", ".join(f"{_trend_sql(m)} AS {M.TREND[m]}" for m in M.METRICS) + f" FROM fx_metrics {_W}")


def _adj_sql(m):
    t, lim = M.TREND[m], (10 if m == "qps" else 0.5)
    return f"CASE WHEN {t} > {lim} THEN {m} * 1.1 WHEN {t} < -{lim} THEN {m} * 0.9 ELSE {m} END"


_ADJ_CTE = ("adj", "SELECT *, " + ", ".join(f"{_adj_sql(m)} AS {M.ADJ[m]}" for m in M.METRICS) + " FROM tr")
_POL_CTE = ("pol", "SELECT d.namespace, d.user_id, d.replicas, coalesce(p.enable_auto_scale_up, true) AS enable_auto_scale_up, "
                   "coalesce(p.enable_auto_scale_down, true) AS enable_auto_scale_down, coalesce(p.scale_up_threshold, 70.0) AS scale_up_threshold, "
                   "coalesce(p.scale_down_threshold, 30.0) AS scale_down_threshold, coalesce(p.min_replicas, 1) AS min_replicas, "
                   "coalesce(p.max_replicas, 10) AS max_replicas, p.user_id IS NOT NULL AS has_policy "
                   "FROM fx_ns_deployments d LEFT JOIN fx_policies p ON p.user_id = d.user_id")
_UP = "(adj_cpu > scale_up_threshold OR adj_memory > scale_up_threshold OR adj_disk > scale_up_threshold OR adj_qps > scale_up_threshold)"
_DOWN = "(adj_cpu < scale_down_threshold AND adj_memory < scale_down_threshold AND adj_disk < scale_down_threshold AND adj_qps < scale_down_threshold)"
_QUOTA_CTE = ("qok", "SELECT t.tenant_id, coalesce(q.current_indices, 0) < coalesce(q.max_indices, 100) AS allowed "
                     "FROM (SELECT DISTINCT user_id AS tenant_id FROM fx_ns_deployments) t LEFT JOIN fx_tenant_quota q ON q.tenant_id = t.tenant_id")
_DEC_CTE = ("dec", "SELECT a.*, p.user_id, p.replicas, p.enable_auto_scale_up, p.enable_auto_scale_down, p.scale_up_threshold, "
                   "p.scale_down_threshold, p.min_replicas, p.max_replicas, q.allowed AS quota_ok, "
                   f"p.enable_auto_scale_up AND {_UP} AS want_up, p.enable_auto_scale_down AND {_DOWN} AS want_down, "
                   f"{_UP} AS should_up, {_DOWN} AS should_down "
                   "FROM adj a JOIN pol p ON p.namespace = a.namespace LEFT JOIN qok q ON q.tenant_id = p.user_id")
_M_VIEWS = ["fx_metrics", "fx_ns_deployments", "fx_policies", "fx_tenant_quota"]
_M_CTES = [_TREND_CTE, _ADJ_CTE, _POL_CTE, _QUOTA_CTE, _DEC_CTE]


def _tgt_sql(cur):
    up = f"(CASE WHEN least(floor({cur} * 1.5), 10) <= {cur} THEN {cur} + 1 ELSE least(floor({cur} * 1.5), 10) END)"
    dn = f"(CASE WHEN greatest(floor({cur} * 0.5), 1) >= {cur} THEN {cur} - 1 ELSE greatest(floor({cur} * 0.5), 1) END)"
    return f"CAST(CASE WHEN want_up THEN {up} WHEN want_down THEN {dn} ELSE {cur} END AS BIGINT)"


def decisions(spark, sf_dir, per_resource=False, metrics=None):
    deps = v(spark, sf_dir, "fx_ns_deployments")
    q = quota_check(deps.select(F.col("user_id").alias("tenant_id")), v(spark, sf_dir, "fx_tenant_quota"))
    metrics = v(spark, sf_dir, "fx_metrics") if metrics is None else metrics
    return M.decision_inputs(metrics, deps, v(spark, sf_dir, "fx_policies"), q, per_resource)


@job("M1_load_class", with_views(
    "SELECT id, namespace, CASE WHEN cpu_usage > 80 OR memory_usage > 80 THEN 'high_load' WHEN cpu_usage < 20 AND memory_usage < 20 "
    "THEN 'low_load' ELSE 'normal' END AS load_class FROM fx_metrics", ["fx_metrics"]), "metric")
def m1(spark, sf_dir):
    m = v(spark, sf_dir, "fx_metrics")
    return m.select("id", "namespace", M.load_class(F.col("cpu_usage"), F.col("memory_usage")).alias("load_class"))


@job("M2_status_refresh", with_views(
    "SELECT d.namespace, d.user_id, CAST(d.replicas AS BIGINT) AS replicas, l.cpu_usage, l.memory_usage, l.disk_usage, l.qps, l.ts AS updated_at, "
    "CASE WHEN l.cpu_usage > 80 OR l.memory_usage > 80 THEN 'high_load' WHEN l.cpu_usage < 20 AND l.memory_usage < 20 THEN 'low_load' ELSE 'normal' END AS load_class "
    "FROM fx_ns_deployments d JOIN (SELECT namespace, arg_max(cpu_usage, (ts, id)) AS cpu_usage, arg_max(memory_usage, (ts, id)) AS memory_usage, "
    "arg_max(disk_usage, (ts, id)) AS disk_usage, arg_max(qps, (ts, id)) AS qps, max(ts) AS ts FROM fx_metrics GROUP BY namespace) l "
    "ON l.namespace = d.namespace", ["fx_metrics", "fx_ns_deployments"]), "metric")
def m2(spark, sf_dir):
    latest = A.latest_metrics(v(spark, sf_dir, "fx_metrics"))
    out = M.status_refresh(latest, v(spark, sf_dir, "fx_ns_deployments"))
    return out.select("namespace", "user_id", "replicas", "cpu_usage", "memory_usage", "disk_usage", "qps",
                      F.col("ts").alias("updated_at"), "load_class")


@job("M3_metric_history5", with_views(
    f"SELECT id, namespace, CAST(count(*) OVER w AS BIGINT) AS hist_n, first_value(id) OVER w AS hist_first_id FROM fx_metrics {_W}",
    ["fx_metrics"]), "metric")
def m3(spark, sf_dir):
    return M.metric_history(v(spark, sf_dir, "fx_metrics")).select("id", "namespace", "hist_n", "hist_first_id")


@job("M4_metric_trend", with_views(
    "SELECT id, namespace, " + ", ".join(f"round({M.TREND[m]}, 6) AS {M.TREND[m]}" for m in M.METRICS) + " FROM tr",
    ["fx_metrics"], [_TREND_CTE]), "metric")
def m4(spark, sf_dir):
    t = M.metric_trend(v(spark, sf_dir, "fx_metrics"))
    return t.select("id", "namespace", *[F.round(M.TREND[m], 6).alias(M.TREND[m]) for m in M.METRICS])


@job("M5_trend_adjust", with_views(
    "SELECT id, namespace, " + ", ".join(f"round({M.ADJ[m]}, 6) AS {M.ADJ[m]}" for m in M.METRICS) + " FROM adj",
    ["fx_metrics"], [_TREND_CTE, _ADJ_CTE]), "metric")
def m5(spark, sf_dir):
    t = M.trend_adjust(M.metric_trend(v(spark, sf_dir, "fx_metrics")))
    return t.select("id", "namespace", *[F.round(M.ADJ[m], 6).alias(M.ADJ[m]) for m in M.METRICS])


@job("M6_effective_policy", with_views("SELECT * REPLACE (CAST(replicas AS BIGINT) AS replicas, CAST(min_replicas AS BIGINT) AS min_replicas, CAST(max_replicas AS BIGINT) AS max_replicas) FROM pol", ["fx_ns_deployments", "fx_policies"], [_POL_CTE]), "metric")
def m6(spark, sf_dir):
    return M.effective_policy(v(spark, sf_dir, "fx_ns_deployments"), v(spark, sf_dir, "fx_policies"))


@job("M7_should_scale_up", with_views("SELECT id, namespace, should_up AS should_scale_up FROM dec", _M_VIEWS, _M_CTES), "metric")
def m7(spark, sf_dir):
    d = decisions(spark, sf_dir)
    return d.select("id", "namespace", M.should_scale_up(d).alias("should_scale_up"))


@job("M8_should_scale_down", with_views("SELECT id, namespace, should_down AS should_scale_down FROM dec", _M_VIEWS, _M_CTES), "metric")
def m8(spark, sf_dir):
    d = decisions(spark, sf_dir)
    return d.select("id", "namespace", M.should_scale_down(d).alias("should_scale_down"))


@job("M9_target_replicas", with_views(
    f"SELECT id, namespace, CAST(replicas AS BIGINT) AS current_replicas, {_tgt_sql('replicas')} AS target_replicas FROM dec",
    _M_VIEWS, _M_CTES), "metric")
def m9(spark, sf_dir):
    d = decisions(spark, sf_dir)
    return d.select("id", "namespace", F.col("replicas").cast("long").alias("current_replicas"),
                    M.target_replicas(F.col("replicas"), F.col("want_up"), F.col("want_down")).alias("target_replicas"))


@job("M10_policy_clamp", with_views(
    f"SELECT id, namespace, {_tgt_sql('replicas')} AS target_replicas, "
    f"CAST(greatest(least({_tgt_sql('replicas')}, max_replicas), min_replicas) AS BIGINT) AS clamped_replicas FROM dec",
    _M_VIEWS, _M_CTES), "metric")
def m10(spark, sf_dir):
    d = decisions(spark, sf_dir)
    t = M.target_replicas(F.col("replicas"), F.col("want_up"), F.col("want_down"))
    return d.select("id", "namespace", t.alias("target_replicas"),
                    M.policy_clamp(t, F.col("min_replicas"), F.col("max_replicas")).alias("clamped_replicas"))


@job("M12_quota_gate", with_views(
    f"SELECT id, namespace, c AS clamped_replicas, NOT (c > replicas AND user_id <> '' AND quota_ok = false) AS quota_pass FROM ("
    f"SELECT *, CAST(greatest(least({_tgt_sql('replicas')}, max_replicas), min_replicas) AS BIGINT) AS c FROM dec) x",
    _M_VIEWS, _M_CTES), "metric")
def m12(spark, sf_dir):
    d = decisions(spark, sf_dir)
    c = M.policy_clamp(M.target_replicas(F.col("replicas"), F.col("want_up"), F.col("want_down")),
                       F.col("min_replicas"), F.col("max_replicas"))
    blocked = (c > F.col("replicas")) & (F.col("user_id") != "") & (F.col("quota_ok") == F.lit(False))
    return d.select("id", "namespace", c.alias("clamped_replicas"), (~F.coalesce(blocked, F.lit(False))).alias("quota_pass"))


def scan_sql(static: bool, ctes=None) -> str:
    cur = "t.replicas" if static else "s.cur_state"
    ticks = ("ticks", "SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY ts, id) AS rn FROM dec")
    header = "scan(namespace, rn, id, ts, cur_state, last_ts, current_replicas, target_replicas, action, reason)"
    rec = (
        "SELECT namespace, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS TIMESTAMP), CAST(replicas AS BIGINT), CAST(NULL AS TIMESTAMP), "
        "CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM fx_ns_deployments "
        "UNION ALL "
        "SELECT namespace, rn, id, ts, CASE WHEN action <> 'none' THEN tgt2 ELSE cur END, CASE WHEN action <> 'none' THEN ts ELSE last_ts END, "
        "cur, CASE WHEN stage IN ('disabled', 'nochange') THEN cur WHEN stage = 'cooldown' THEN tgt ELSE tgt2 END, action, reason FROM ("
        "SELECT *, CASE WHEN reason = 'executed' THEN CASE WHEN tgt2 > cur THEN 'scale_up' ELSE 'scale_down' END ELSE 'none' END AS action FROM ("
        "SELECT *, CASE stage WHEN 'disabled' THEN 'autoscaling disabled' WHEN 'nochange' THEN 'no change' WHEN 'cooldown' THEN 'cooldown' "
        "ELSE CASE WHEN tgt2 > cur AND user_id <> '' AND quota_ok = false THEN 'quota exceeded' WHEN tgt2 = cur THEN 'at policy limit' "
        "ELSE 'executed' END END AS reason FROM ("
        "SELECT *, CASE WHEN NOT (enable_auto_scale_up OR enable_auto_scale_down) THEN 'disabled' WHEN tgt = cur THEN 'nochange' "
        "WHEN last_ts IS NOT NULL AND epoch_us(ts) - epoch_us(last_ts) < (CASE WHEN tgt > cur THEN 300 ELSE 600 END) * 1000000 THEN 'cooldown' "
        "ELSE 'go' END AS stage, CAST(greatest(least(tgt, max_replicas), min_replicas) AS BIGINT) AS tgt2 FROM ("
        f"SELECT *, {_tgt_sql('cur')} AS tgt FROM ("
        f"SELECT t.namespace, t.rn, t.id, t.ts, t.user_id, t.want_up, t.want_down, t.enable_auto_scale_up, t.enable_auto_scale_down, "
        f"t.min_replicas, t.max_replicas, t.quota_ok, s.last_ts, CAST({cur} AS BIGINT) AS cur "
        "FROM scan s JOIN ticks t ON t.namespace = s.namespace AND t.rn = s.rn + 1) x1) x2) x3) x4) x5")
    body = "SELECT namespace, id, ts, current_replicas, target_replicas, action, reason FROM scan WHERE rn > 0"
    return with_views(body, _M_VIEWS, (ctes or _M_CTES) + [ticks], recursive=(header, rec))


@job("M11_cooldown_gate", scan_sql(static=True), "metric")
def m11(spark, sf_dir):
    """Cooldown gate over each namespace's ticks with the deployment's replica count held fixed."""
    return scaling_scan_chunked(decisions(spark, sf_dir), static_current=True)


@job("M13_scaling_recommendations", scan_sql(static=False), "metric")
def m13(spark, sf_dir):
    """Whole chain M1-M12: replica count and last action time carried from tick to tick."""
    return scaling_scan_chunked(decisions(spark, sf_dir))


# One namespace with over a third of all ticks, cut into chunks of a few hundred, which are composed in two levels.
_HOT_CTES = [("hot", "SELECT * REPLACE (CASE WHEN id % 3 = 0 THEN 'ns-0' ELSE namespace END AS namespace) FROM fx_metrics"),
             ("tr", _TREND_CTE[1].replace("FROM fx_metrics", "FROM hot")), *_M_CTES[1:]]


@job("M13_scaling_recommendations_hot", scan_sql(static=False, ctes=_HOT_CTES), "metric")
def m13_hot(spark, sf_dir):
    """The chain with a hot namespace, far over the ticks of one chunk."""
    m = v(spark, sf_dir, "fx_metrics")
    m = m.withColumn("namespace", F.when(F.col("id") % 3 == 0, "ns-0").otherwise(F.col("namespace")))
    return scaling_scan_chunked(decisions(spark, sf_dir, metrics=m), target_rows=300, fan_in=4)


@job("M14_metric_retention", with_views(
    "SELECT id, namespace, ts FROM fx_metrics WHERE ts >= (SELECT max(ts) FROM fx_metrics) - INTERVAL 15 DAY", ["fx_metrics"]), "metric")
def m14(spark, sf_dir):
    return M.metric_retention(v(spark, sf_dir, "fx_metrics")).select("id", "namespace", "ts")


@job("M15_counter_rate", with_views(
    "SELECT id, namespace, round(CASE WHEN s - min(s) OVER r > 0 THEN (sum(inc) OVER r - first_value(inc) OVER r) / (s - min(s) OVER r) END, 6) AS rate "
    "FROM (SELECT *, epoch_us(ts) / 1000000.0 AS s, CAST(CASE WHEN lag(counter) OVER (PARTITION BY namespace ORDER BY ts, id) IS NULL THEN 0 "
    "WHEN counter < lag(counter) OVER (PARTITION BY namespace ORDER BY ts, id) THEN counter "
    "ELSE counter - lag(counter) OVER (PARTITION BY namespace ORDER BY ts, id) END AS DOUBLE) AS inc FROM fx_counters) c "
    "WINDOW r AS (PARTITION BY namespace ORDER BY s RANGE BETWEEN 300 PRECEDING AND CURRENT ROW)", ["fx_counters"]), "metric")
def m15(spark, sf_dir):
    r = M.counter_rate(v(spark, sf_dir, "fx_counters"))
    return r.select("id", "namespace", F.round("rate", 6).alias("rate"))


@job("M16_disk_used_pct", with_views(
    "SELECT id, namespace, round((1.0 - avail_bytes / size_bytes) * 100.0, 6) AS disk_used_pct FROM fx_counters", ["fx_counters"]), "metric")
def m16(spark, sf_dir):
    c = v(spark, sf_dir, "fx_counters")
    return c.select("id", "namespace", F.round(M.disk_used_pct(c), 6).alias("disk_used_pct"))
