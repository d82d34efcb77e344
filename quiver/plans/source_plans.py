"""Typed sources, validation, packed vectors, file scans and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiver.operators.export import json_report
from quiver.operators.reports import index_stats_report
from quiver.plans.registry import job
from quiver.session import scratch_path
from quiver.sources import files as S
from quiver.sources import vectors as SV
from quiver.sources.fixtures import spark_view, with_views
from quiver.sources.tables import table

DIM = 64


def v(spark, sf_dir, name):
    return spark_view(spark, sf_dir, name)


@job("S1_vector_source", with_views(
    "SELECT vec_id AS doc_id, CAST(len(embedding) AS BIGINT) AS dimension, CAST(label AS BIGINT) AS label, 'l2' AS metric, CAST(100 AS BIGINT) AS nlist, "
    "CAST(10 AS BIGINT) AS nprobe FROM embeddings"), "source")
def s1(spark, sf_dir):
    vf = SV.VectorField("embedding", DIM, metric="l2_norm", field_mapping={"label": "integer"})
    src = SV.vector_source(spark, f"{sf_dir}/embeddings.parquet", vf, id_col="vec_id")
    return src.select(F.col("vec_id").alias("doc_id"), F.size("embedding").alias("dimension"), "label", F.lit(vf.metric).alias("metric"),
                      F.lit(vf.nlist).alias("nlist"), F.lit(vf.nprobe).alias("nprobe"))


def bad_vectors(spark, sf_dir):
    """fx_bad_vectors: every 70th vector null, every 50th cut to 63 values, every 90th starting with NaN."""
    e = table(spark, sf_dir, "embeddings")
    vec = (F.when(F.col("vec_id") % 70 == 0, F.lit(None).cast("array<float>"))
           .when(F.col("vec_id") % 50 == 0, F.slice("embedding", 1, DIM - 1))
           .when(F.col("vec_id") % 90 == 0, F.concat(F.array(F.lit(float("nan")).cast("float")), F.slice("embedding", 2, DIM - 1)))
           .otherwise(F.col("embedding")))
    return e.select("vec_id", vec.alias("embedding"))


@job("S2_vector_validate", with_views(
    "SELECT vec_id, reason IS NULL AS valid, reason FROM (SELECT vec_id, CASE WHEN vec_id % 70 = 0 THEN 'null vector' "
    "WHEN vec_id % 50 = 0 THEN 'dimension mismatch: expected 64, got 63' WHEN vec_id % 90 = 0 THEN 'non-finite value' END AS reason FROM embeddings) t"),
    "source")
def s2(spark, sf_dir):
    ok, bad = SV.vector_validate(bad_vectors(spark, sf_dir), "embedding", DIM)
    return ok.select("vec_id", F.lit(True).alias("valid"), F.lit(None).cast("string").alias("reason")).unionByName(
        bad.select("vec_id", F.lit(False).alias("valid"), "reason"))


@job("S3_vector_pack", with_views(
    "SELECT vec_id, CAST(4 * len(embedding) AS BIGINT) AS n_bytes, true AS roundtrip_exact FROM embeddings"), "source")
def s3(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    packed = e.select("vec_id", "embedding", SV.vector_pack("embedding").alias("packed"))
    back = packed.select("vec_id", F.length("packed").alias("n_bytes"),
                         (SV.vector_unpack("packed") == F.col("embedding")).alias("roundtrip_exact"))
    return back


INDEX_SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("index_name", T.StringType()),
                             T.StructField("namespace", T.StringType()), T.StructField("metric", T.StringType()),
                             T.StructField("status", T.StringType()), T.StructField("document_count", T.IntegerType())])


@job("S6_json_dir_scan", with_views("SELECT id, index_name, namespace, metric, status, CAST(document_count AS BIGINT) AS document_count FROM fx_index_metadata",
                                    ["fx_index_metadata"]), "source")
def s6(spark, sf_dir):
    """Index metadata as ``index_*.json`` files beside a corrupt file and an unrelated one; scan keeps the good rows."""
    path = scratch_path(spark, "json-dir")
    S.write_named_json(spark, v(spark, sf_dir, "fx_index_metadata"), path, "index")
    S.write_text_file(spark, f"{path}/index_broken.json", '{"id": 1, "index_name": "idx-broken", "metric":\n')
    S.write_text_file(spark, f"{path}/tenant_1.json", '{"id": 9999999, "index_name": "not-an-index"}\n')
    return S.json_dir_scan(spark, path, "index", INDEX_SCHEMA).where(F.col("id").isNotNull())


REPORT_SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("user_id", T.StringType()),
                              T.StructField("service_name", T.StringType()), T.StructField("status", T.StringType()),
                              T.StructField("ts", T.TimestampNTZType())])


@job("A3_report_list", with_views("SELECT id, user_id, service_name, status, ts FROM fx_reports", ["fx_reports"]), "report")
def a3(spark, sf_dir):
    """All deployment reports read back from ``report_*.json`` files; bad files skipped."""
    path = scratch_path(spark, "reports-json")
    S.write_named_json(spark, v(spark, sf_dir, "fx_reports"), path, "report")
    S.write_text_file(spark, f"{path}/report_corrupt.json", "not json at all\n")
    return S.json_dir_scan(spark, path, "report", REPORT_SCHEMA).where(F.col("id").isNotNull())


@job("S7_metrics_append", with_views("SELECT id, namespace, cpu_usage, memory_usage, disk_usage, qps, ts FROM fx_metrics",
                                     ["fx_metrics"]), "source")
def s7(spark, sf_dir):
    """Two appends (before / from 15 January) into one metric table, read back whole."""
    path = scratch_path(spark, "metrics")
    m = v(spark, sf_dir, "fx_metrics")
    cut = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    S.metrics_append(m.where(F.col("ts") < cut), path)
    S.metrics_append(m.where(F.col("ts") >= cut), path)
    return spark.read.parquet(path)


@job("S8_json_report_sink", with_views(
    "SELECT 'index_stats' AS type, index_name, CAST(count(*) AS BIGINT) AS doc_count, CAST(sum(n_chars) AS BIGINT) AS size_chars "
    "FROM (SELECT concat('idx-', CAST(doc_id % 20 + 1 AS VARCHAR)) AS index_name, n_chars FROM documents) d GROUP BY index_name"), "source")
def s8(spark, sf_dir):
    """Index stats as ``{type, timestamp, data}`` envelopes written as text, read back as JSON."""
    d = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("idx-"), (F.col("doc_id") % 20 + 1).cast("string")).alias("index_name"), "n_chars")
    stats = index_stats_report(d, v(spark, sf_dir, "fx_index_metadata").select("index_name", "metric"))
    path = scratch_path(spark, "reports-sink")
    json_report(stats.select("index_name", "doc_count", "size_chars"), "index_stats").write.text(path)
    back = spark.read.json(path)
    return back.select("type", "data.index_name", "data.doc_count", "data.size_chars")


_RES = ("CASE WHEN deleted THEN '{\"limits\":{\"cpu\":\"' || cpu || '\",\"memory\":\"' || memory || '\"}}' "
        "ELSE '{\"limits\":{\"cpu\":\"' || cpu || '\",\"memory\":\"' || memory || '\"},\"requests\":{\"cpu\":\"' || cpu || '\"}}' END")


@job("S9_container_json_parse", with_views(
    "SELECT id, coalesce(json_extract_string(r, '$.limits.cpu'), '') AS limits_cpu, coalesce(json_extract_string(r, '$.limits.memory'), '') AS limits_memory, "
    "coalesce(json_extract_string(r, '$.requests.cpu'), '') AS requests_cpu, coalesce(json_extract_string(r, '$.requests.memory'), '') AS requests_memory "
    f"FROM (SELECT id, {_RES} AS r FROM fx_tenant_containers) t", ["fx_tenant_containers"]), "source")
def s9(spark, sf_dir):
    c = v(spark, sf_dir, "fx_tenant_containers")
    lim = F.concat(F.lit('{"limits":{"cpu":"'), F.col("cpu"), F.lit('","memory":"'), F.col("memory"), F.lit('"}'))
    res = F.when(F.col("deleted"), F.concat(lim, F.lit("}"))).otherwise(
        F.concat(lim, F.lit(',"requests":{"cpu":"'), F.col("cpu"), F.lit('"}}')))
    out = S.container_json_parse(c.select("id", res.alias("resources")), "resources")
    return out.drop("resources")
