"""L1-L9 over the ``fx_logs`` fixture (plus events as a system-journal stream)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quiver.operators import logs as L
from quiver.plans.registry import job
from quiver.session import scratch_path
from quiver.sources.fixtures import spark_view, with_views
from quiver.sources.tables import table

BUCKET_LINES = 1000   # small buckets in the registered job so the cross-bucket carry is exercised
HOST, NODE, PREFIX = "collector-0", "node-0", "k8s-node-0"


def v(spark, sf_dir, name):
    return spark_view(spark, sf_dir, name)


_L1 = ("l1", "SELECT line_no, tag, raw, json_valid(raw) AND ltrim(raw) LIKE '{%' AS ok FROM fx_logs")
_L1P = ("l1p", "SELECT line_no, tag, CASE WHEN ok THEN json_extract_string(raw, '$.log') END AS log, "
               "CASE WHEN ok THEN json_extract_string(raw, '$.kubernetes.namespace_name') END AS namespace_name, "
               "CASE WHEN ok THEN json_extract_string(raw, '$.kubernetes.pod_name') END AS pod_name, "
               "CASE WHEN ok THEN json_extract_string(raw, '$.kubernetes.container_name') END AS container_name, "
               "CASE WHEN NOT ok THEN raw END AS unmatched FROM l1")
_ES = ("es", "SELECT line_no, raw, regexp_matches(raw, '^\\d{4}-\\d{2}-\\d{2}') AS f FROM fx_logs WHERE tag = 'elasticsearch'")
_ST = ("st", "SELECT *, max(CASE WHEN f THEN line_no END) OVER (ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM es")
_REC = ("rec", "SELECT coalesce(s, (SELECT min(line_no) FROM st WHERE s IS NULL)) AS record_start, CAST(count(*) AS BIGINT) AS lines, "
               "string_agg(raw, chr(10) ORDER BY line_no) AS text FROM st GROUP BY 1")
_ESRE = "'(?s)^(\\d{4}-\\d{2}-\\d{2}[ ]\\d{2}:\\d{2}:\\d{2}\\.\\d{3})[ ][A-Z][ ](.*)'"
_RF = ("rf", f"SELECT record_start, lines, text, CASE WHEN regexp_matches(text, {_ESRE}) THEN strptime(regexp_extract(text, {_ESRE}, 1), '%Y-%m-%d %H:%M:%S.%g') END AS time, "
             f"CASE WHEN regexp_matches(text, {_ESRE}) THEN regexp_extract(text, {_ESRE}, 2) END AS message FROM rec")
_SYS = ("sys", "SELECT event_id, event_type || ' ' || props AS MESSAGE, ts AS time FROM events WHERE regexp_matches(event_type || ' ' || props, '(?i)(Warning|Error|Fail)')")
# journal units of the events: a fifth is the kernel's, a fifth a unit that nobody follows
_UNIT = "case event_id % 5 when 0 then 'kernel.service' when 4 then 'cron.service' else 'kubelet.service' end"
_KUBE = ("kube", f"SELECT line_no, log, namespace_name AS kubernetes_ns, pod_name AS kubernetes_pod, container_name AS kubernetes_container, "
                 f"'{HOST}' AS hostname, '{NODE}' AS node_name FROM l1p WHERE tag LIKE 'kubernetes%' AND coalesce(namespace_name = '{L.ALLOWED_NAMESPACE}', false)")
_ROUTE = ("routed", "SELECT 'kubernetes' AS route, line_no AS record_key, log AS message, CAST(NULL AS TIMESTAMP) AS time FROM kube "
                    "UNION ALL SELECT 'elasticsearch', record_start, message, time FROM rf "
                    "UNION ALL SELECT CASE event_id % 5 WHEN 0 THEN 'kernel' ELSE 'kubelet' END, event_id, MESSAGE, time FROM sys WHERE event_id % 5 <> 4")
_LV = ["fx_logs"]


def parsed_lines(spark, sf_dir):
    return L.json_source(v(spark, sf_dir, "fx_logs"))


def es_records(spark, sf_dir):
    es = v(spark, sf_dir, "fx_logs").where("tag = 'elasticsearch'")
    return L.regex_fields(L.multiline_records(es, bucket_lines=BUCKET_LINES))


def system_records(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return L.severity_filter(e.select("event_id", F.concat_ws(" ", "event_type", "props").alias("MESSAGE"),
                                      F.col("ts").alias("time")))


def kube_records(spark, sf_dir):
    k = parsed_lines(spark, sf_dir).where(F.col("tag").startswith("kubernetes"))
    return L.enrich(L.namespace_filter(k), HOST, NODE)


def routed(spark, sf_dir):
    k = kube_records(spark, sf_dir).select(F.col("line_no").alias("record_key"), F.col("log").alias("message"),
                                           F.lit(None).cast("timestamp_ntz").alias("time"))
    e = es_records(spark, sf_dir).select(F.col("record_start").alias("record_key"), "message", "time")
    s = L.journal_source(system_records(spark, sf_dir).withColumn("unit", F.expr(_UNIT)))
    s = {tag: s.where(F.col("tag") == tag).select(F.col("event_id").alias("record_key"), F.col("MESSAGE").alias("message"), "time")
         for tag in ("kubelet", "kernel")}
    return L.route({"kubernetes": k, "elasticsearch": e, **s})


# The container's time and name in every kube line; each seventh time lacks its zone, so it is none.
_KUBE_RAW = ("replace(replace(raw, '{\"log\":', concat('{\"time\":\"2024-01-01T', lpad(cast(cast(floor(line_no / 3600) as bigint) % 24 as TEXT), 2, '0'), ':', "
             "lpad(cast(cast(floor(line_no / 60) as bigint) % 60 as TEXT), 2, '0'), ':', lpad(cast(line_no % 60 as TEXT), 2, '0'), '.', "
             "lpad(cast(line_no * 1000 % 1000000000 as TEXT), 9, '0'), case when line_no % 7 = 0 then '' else 'Z' end, '\",\"log\":')), "
             "'\"pod_name\":', concat('\"container_name\":\"c-', cast(line_no % 3 as TEXT), '\",\"pod_name\":'))")
_FULL = [("lines", f"SELECT line_no, tag, {_KUBE_RAW.replace('TEXT', 'VARCHAR')} AS raw FROM fx_logs"),
         ("l1", _L1[1].replace("FROM fx_logs", "FROM lines")),
         ("l1p", _L1P[1].replace("SELECT line_no, tag,", "SELECT line_no, tag, CASE WHEN ok AND line_no % 7 <> 0 THEN TIMESTAMP '2024-01-01' "
                                 "+ to_seconds(line_no % 86400) + to_microseconds(line_no * 1000 % 1000000000 // 1000) END AS time,", 1))]


@job("L1_log_json_source", with_views(
    "SELECT line_no, tag, log, time, namespace_name, pod_name, container_name, unmatched FROM l1p", _LV, _FULL), "log")
def l1(spark, sf_dir):
    lines = v(spark, sf_dir, "fx_logs").withColumn("raw", F.expr(_KUBE_RAW.replace("TEXT", "string")))
    return L.json_source(lines).select("line_no", "tag", "log", "time", *[F.col(f"kubernetes.{c}").alias(c) for c in (
        "namespace_name", "pod_name", "container_name")], "unmatched")


@job("L2_log_multiline", with_views("SELECT * FROM rec", _LV, [_ES, _ST, _REC]), "log")
def l2(spark, sf_dir):
    es = v(spark, sf_dir, "fx_logs").where("tag = 'elasticsearch'")
    return L.multiline_records(es, bucket_lines=BUCKET_LINES)


@job("L3_log_regex_fields", with_views("SELECT record_start, time, message FROM rf", _LV, [_ES, _ST, _REC, _RF]), "log")
def l3(spark, sf_dir):
    return es_records(spark, sf_dir).select("record_start", "time", "message")


@job("L4_log_namespace_filter", with_views(
    f"SELECT line_no, tag FROM l1p WHERE NOT (tag LIKE 'kubernetes%') OR coalesce(namespace_name = '{L.ALLOWED_NAMESPACE}', false)",
    _LV, [_L1, _L1P]), "log")
def l4(spark, sf_dir):
    return L.namespace_filter(parsed_lines(spark, sf_dir)).select("line_no", "tag")


@job("L5_log_severity_filter", with_views("SELECT event_id, MESSAGE FROM sys", [], [_SYS]), "log")
def l5(spark, sf_dir):
    return system_records(spark, sf_dir).select("event_id", "MESSAGE")


@job("L6_log_enrich", with_views(
    "SELECT line_no, hostname, node_name, kubernetes_ns, kubernetes_pod, kubernetes_container FROM kube", _LV, [_L1, _L1P, _KUBE]), "log")
def l6(spark, sf_dir):
    return kube_records(spark, sf_dir).select("line_no", "hostname", "node_name", "kubernetes_ns", "kubernetes_pod",
                                              "kubernetes_container")


_PODS = ("pods", "SELECT pod AS pod_name, min(namespace) AS pod_namespace, CAST(count(*) AS BIGINT) AS samples FROM fx_pod_usage GROUP BY pod")


@job("L7_log_metadata_join", with_views(
    "SELECT k.line_no, k.kubernetes_pod, p.pod_namespace, p.samples FROM kube k LEFT JOIN pods p ON p.pod_name = k.kubernetes_pod",
    _LV + ["fx_pod_usage"], [_L1, _L1P, _KUBE, _PODS]), "log")
def l7(spark, sf_dir):
    pods = v(spark, sf_dir, "fx_pod_usage").groupBy(F.col("pod").alias("pod_name")).agg(
        F.min("namespace").alias("pod_namespace"), F.count(F.lit(1)).alias("samples"))
    return L.metadata_join(kube_records(spark, sf_dir), pods).select("line_no", "kubernetes_pod", "pod_namespace", "samples")


@job("L8_log_route", with_views("SELECT route, record_key, message FROM routed", _LV,
                                [_L1, _L1P, _KUBE, _ES, _ST, _REC, _RF, _SYS, _ROUTE]), "log")
def l8(spark, sf_dir):
    return routed(spark, sf_dir).select("route", "record_key", "message")


@job("L9_log_fanout_sink", with_views(
    f"SELECT 'es' AS sink, '{PREFIX}' AS logstash_prefix, coalesce(strftime(time, '%Y.%m.%d'), 'unknown') AS day, CAST(count(*) AS BIGINT) AS records "
    "FROM routed GROUP BY 1, 2, 3 UNION ALL SELECT 'file', '', '', CAST(count(*) AS BIGINT) FROM routed", _LV,
    [_L1, _L1P, _KUBE, _ES, _ST, _REC, _RF, _SYS, _ROUTE]), "log")
def l9(spark, sf_dir):
    """Write the routed records to both sinks, then count what each sink holds."""
    base = scratch_path(spark, "logs")
    L.fanout_write(routed(spark, sf_dir), f"{base}/es", f"{base}/file", PREFIX)
    es = spark.read.parquet(f"{base}/es").groupBy("logstash_prefix", "day").agg(F.count(F.lit(1)).alias("records"))
    fl = spark.read.json(f"{base}/file").agg(F.count(F.lit(1)).alias("records"))
    return es.select(F.lit("es").alias("sink"), "logstash_prefix", "day", "records").unionByName(
        fl.select(F.lit("file").alias("sink"), F.lit("").alias("logstash_prefix"), F.lit("").alias("day"), "records"))
