"""Text parsers, scaling decisions, tenant tables, health rules and logs on small inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quiver.functions import text as U
from quiver.operators import health as H
from quiver.operators import logs as L
from quiver.operators import tenants as T
from quiver.operators.scaling import ScalerConfig, decide, target_of


def test_parsers(spark):
    df = spark.createDataFrame([("1500m", "1Gi", "75%", "12"), ("2", "512Mi", "x", ""), ("abc", "2Ti", "3.5%", " 7abc")],
                               "cpu string, mem string, disk string, docs string")
    r = df.select(U.parse_cpu("cpu").alias("c"), U.parse_cpu("cpu", strict=True).alias("cs"),
                  U.parse_memory_mib("mem").alias("m"), U.parse_memory_mib("mem", parity=True).alias("mp"),
                  U.parse_percent("disk").alias("p"), U.parse_doc_count("docs").alias("d")).collect()
    assert [x.c for x in r] == [1.5, 0.002, 0.0]
    assert [x.cs for x in r] == [1.5, 2.0, 0.0]
    assert [x.m for x in r] == [1024.0, 512.0, 2 * 1024 * 1024.0]
    assert [x.mp for x in r] == [1.0, 512.0, 2.0]
    assert [x.p for x in r] == [75.0, 0.0, 3.5]
    assert [x.d for x in r] == [12, 0, 7]


def test_epoch_text(spark):
    r = spark.range(1).select(U.epoch_ms_to_rfc3339(F.lit(1704067200999)).alias("t")).first()
    assert r.t == "2024-01-01T00:00:00Z"


def test_targets_and_quirks():
    cfg = ScalerConfig()
    assert target_of(4, True, False, cfg) == 6
    assert target_of(1, True, False, cfg) == 2          # floor(1.5) = 1 -> at least cur + 1
    assert target_of(10, True, False, cfg) == 11        # capped at 10, then cur + 1
    assert target_of(3, False, True, cfg) == 1
    assert target_of(1, False, True, cfg) == 0          # floored at 1, then cur - 1
    # at the policy max the clamped target equals current: no action unless parity keeps the no-op
    assert decide(5, None, 0, True, True, True, False, 1, 5, "u", True, cfg)[1:3] == ("none", "at policy limit")
    assert decide(5, None, 0, True, True, True, False, 1, 5, "u", True, cfg, parity_noop=True)[1] == "noop_scale"
    # cooldown: up needs 300 s, down 600 s since the last action
    assert decide(2, 0, 299_000_000, True, True, True, False, 1, 10, "u", True, cfg)[2] == "cooldown"
    assert decide(2, 0, 300_000_000, True, True, True, False, 1, 10, "u", True, cfg)[2] == "executed"
    assert decide(4, 0, 599_000_000, True, True, False, True, 1, 10, "u", True, cfg)[2] == "cooldown"
    # quota gates increases only
    assert decide(2, None, 0, True, True, True, False, 1, 10, "u", False, cfg)[2] == "quota exceeded"
    assert decide(4, None, 0, True, True, False, True, 1, 10, "u", False, cfg)[2] == "executed"
    assert decide(2, None, 0, False, False, True, False, 1, 10, "u", True, cfg)[2] == "autoscaling disabled"


def test_quota_defaults(spark):
    tenants = spark.createDataFrame([("a",), ("b",)], "tenant_id string")
    quotas = spark.createDataFrame([("a", 3, 3)], "tenant_id string, max_indices int, current_indices int")
    r = {x.tenant_id: x for x in T.quota_check(tenants, quotas).collect()}
    assert r["a"].allowed is False and r["b"].allowed is True and r["b"].max_indices == 100
    ev = spark.createDataFrame([("a", False), ("a", False), ("c", True)], "tenant_id string, increase boolean")
    u = {x.tenant_id: x.current_indices for x in T.quota_usage_apply(quotas, ev).collect()}
    assert u == {"a": 1, "c": 1}


def test_request_normalise(spark):
    df = spark.createDataFrame([(1, "o", "u", "s", "", 0, "", "4", "", 0)],
                               "id long, tenant_org_id string, user_id string, service_name string, namespace string, "
                               "replicas int, cpu string, memory string, disk string, dimension int")
    r = T.request_normalise(df).first()
    assert (r.namespace, r.replicas, r.cpu, r.memory, r.disk, r.dimension, r.vector_count) == \
        ("o-u-s", 1, "500m", "4Gi", "10Gi", 128, 10000)
    assert r.reject_reason is None


def shards(spark, rows):
    return spark.createDataFrame(rows, H.SHARD_SCHEMA)


def test_consistency_rules(spark):
    rows = [("i", "0", "p", "STARTED", "100", "1mb", "n1"), ("i", "0", "r", "STARTED", "111", "1mb", "n2"),
            ("i", "1", "p", "STARTED", "100", "1mb", "n1"), ("i", "1", "r", "INITIALIZING", "", "1mb", "n3"),
            ("i", "2", "p", "STARTED", "5", "1mb", "n1"), ("i", "2", "r", "STARTED", "15", "2mb", "n2"),
            ("j", "0", "p", "STARTED", "1", "1mb", "n1")]
    sc = {(r.index_name, r.shard): r for r in H.shard_consistency(shards(spark, rows)).collect()}
    assert not sc[("i", "0")].is_consistent and "diff=11" in sc[("i", "0")].issues[0]
    assert not sc[("i", "1")].is_consistent and "not STARTED" in sc[("i", "1")].issues[0]
    assert sc[("i", "2")].is_consistent                              # diff 10 is tolerated
    assert sc[("j", "0")].is_consistent and sc[("j", "0")].issues == ["No replica shards found for shard 0"]
    ic = {r.index_name: r for r in H.index_consistency(H.shard_consistency(shards(spark, rows))).collect()}
    assert ic["i"].status == "error"                                 # 2 bad of 3: 2 < 3 div 2 is false
    assert ic["j"].status == "consistent" and ic["j"].issues == []   # issues of consistent shards dropped
    mism = H.store_size_mismatch(shards(spark, rows)).collect()
    assert [(m.index_name, m.shard) for m in mism] == [("i", "2")]


def test_replication_status_never_degraded(spark):
    rows = [("a", "0", "p", "STARTED", "1", "", "n"), ("a", "0", "r", "UNASSIGNED", "", "", "n"),
            ("b", "0", "p", "UNASSIGNED", "", "", "n"), ("b", "1", "p", "UNASSIGNED", "", "", "n"),
            ("b", "2", "p", "STARTED", "", "", "n")]
    st = {r.index_name: r.status for r in H.replication_status(shards(spark, rows)).collect()}
    assert st == {"a": "syncing", "b": "failed"}


def test_multiline_across_buckets(spark):
    lines = ["junk before", "2024-01-01 00:00:00.000 I a", "  at x", "  at y", "2024-01-01 00:00:01.000 W b", "  at z"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no long, raw string")
    for bucket in (1, 2, 100):
        recs = sorted((r.record_start, r.lines) for r in L.multiline_records(df, bucket_lines=bucket).collect())
        assert recs == [(0, 1), (1, 3), (4, 2)]
    f = L.regex_fields(L.multiline_records(df)).where("record_start = 1").first()
    assert f.time == dt.datetime(2024, 1, 1) and f.message == "a\n  at x\n  at y"


def test_namespace_and_severity_filters(spark):
    allowed = L.ALLOWED_NAMESPACE
    df = spark.createDataFrame([(1, '{"log":"x","kubernetes":{"namespace_name":"%s"}}' % allowed, "kubernetes.a"),
                                (2, '{"log":"y","kubernetes":{"namespace_name":"other"}}', "kubernetes.b"),
                                (3, "plain text", "elasticsearch")], "line_no long, raw string, tag string")
    kept = sorted(r.line_no for r in L.namespace_filter(L.json_source(df)).collect())
    assert kept == [1, 3]
    sys_ = spark.createDataFrame([("disk FAILURE",), ("all good",), ("warning: x",)], "MESSAGE string")
    assert L.severity_filter(sys_).count() == 2


@pytest.mark.parametrize("static", [True, False])
def test_chunked_scaler_equals_sequential_scan(spark, static):
    """Many tiny chunks (a few ticks each) give exactly the sequential scan's decisions."""
    import quiver.plans.metric_plans as MP
    from quiver.operators.scaler_chunks import scaling_scan_chunked
    from quiver.operators.scaling import scaling_scan

    dec = MP.decisions(spark, "/root/testdata/sf0.001").persist()
    seq = scaling_scan(dec, static_current=static).collect()
    chunked = scaling_scan_chunked(dec, static_current=static, target_rows=3).collect()
    key = lambda r: (r.namespace, r.id)
    assert sorted(seq, key=key) == sorted(chunked, key=key)
    assert any(r.action != "none" for r in seq)
    dec.unpersist()


def test_snapshot_verify_detects_tampering(spark):
    from quiver.operators import export as B
    from quiver.session import scratch_path

    t = spark.createDataFrame([(i, "org-1" if i % 2 else "org-2", f"u{i}") for i in range(20)],
                              "id long, tenant_org_id string, user_id string")
    q = spark.createDataFrame([(f"u{i}", i) for i in range(20)], "tenant_id string, max_indices int")
    root = scratch_path(spark, "test-backup")
    B.export_snapshot(spark, {"containers": t, "quota": q}, "org-1", root, "s1")
    assert [r.snapshot for r in B.list_snapshots(spark, root, "org-1").collect()] == ["s1"]
    v = {r.table_name: (r.rows, r.verified) for r in B.verify_snapshot(spark, root, "org-1", "s1").collect()}
    assert v == {"containers": (10, True), "quota": (10, True)}
    # replace the quota table with different rows of the same count: the checksum catches it
    spark.createDataFrame([(f"x{i}", i) for i in range(10)], "tenant_id string, max_indices int") \
        .write.mode("overwrite").parquet(f"{root}/org-1/s1/quota")
    v = {r.table_name: r.verified for r in B.verify_snapshot(spark, root, "org-1", "s1").collect()}
    assert v == {"containers": True, "quota": False}


def test_vector_pack_is_big_endian_float32(spark):
    from quiver.sources.vectors import vector_pack, vector_unpack

    df = spark.createDataFrame([([1.0, -2.5],), (None,)], "v array<float>")
    r = df.select(vector_pack("v").alias("b")).collect()
    assert bytes(r[0].b) == b"\x3f\x80\x00\x00\xc0\x20\x00\x00" and r[1].b is None
    back = df.select(vector_unpack(vector_pack("v")).alias("v")).collect()
    assert back[0].v == [1.0, -2.5] and back[1].v is None


def test_vector_validate_reasons(spark):
    from quiver.sources.vectors import VectorField, vector_validate

    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0])],
                               "id long, v array<float>")
    ok, bad = vector_validate(df, "v", 2)
    assert [r.id for r in ok.collect()] == [1]
    reasons = {r.id: r.reason for r in bad.collect()}
    assert reasons == {2: "dimension mismatch: expected 2, got 1", 3: "null vector", 4: "non-finite value", 5: "non-finite value"}
    with pytest.raises(ValueError):
        VectorField("v", 0)
    assert VectorField("v", 4, metric="dot_product").metric == "dot"
