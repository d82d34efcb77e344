"""Property tests: text parsers against a plain-Python model; invariants of registered jobs."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as E
from quiver.functions import text as U

SF = "/root/testdata/sf0.001"
NUM = re.compile(r"^\s*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)")
INT = re.compile(r"^\s*([+-]?[0-9]+)")
UNITS = {"Ki": 1 / 1024, "Mi": 1.0, "Gi": 1024.0, "Ti": 1024.0 ** 2, "Pi": 1024.0 ** 3}


def lead(s):
    m = NUM.match(s)
    return float(m.group(1)) if m else None


def model_cpu(s):
    v = lead(s[:-1] if s.endswith("m") else s)
    return (v or 0.0) / 1000.0


def model_mem(s):
    v = lead(s)
    unit = s[-2:] if len(s) >= 2 and s[-2:] in UNITS else None
    return 0.0 if v is None else v * (UNITS[unit] if unit else 1.0)


def model_docs(s):
    m = INT.match(s)
    return int(m.group(1)) if m else 0


texts = st.one_of(
    st.builds(lambda n, u: f"{n}{u}", st.integers(0, 10 ** 6), st.sampled_from(["", "m", "Mi", "Gi", "Ki", "Ti", "%", "x"])),
    st.builds(lambda f, u: f"{f:.3f}{u}", st.floats(0, 1e5, allow_nan=False), st.sampled_from(["", "m", "Gi", "%"])),
    st.text(alphabet="0123456789.+-emGiKMT% ", max_size=8),
)


@settings(max_examples=6, deadline=None)
@given(st.lists(texts, min_size=50, max_size=80))
def test_parsers_match_model(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    rows = df.select("s", U.parse_cpu("s").alias("c"), U.parse_memory_mib("s").alias("m"),
                     U.parse_doc_count("s").alias("d")).collect()
    for r in rows:
        assert r.c == pytest.approx(model_cpu(r.s), rel=1e-12, abs=1e-12), r.s
        assert r.m == pytest.approx(model_mem(r.s), rel=1e-12, abs=1e-12), r.s
        if abs(model_docs(r.s)) < 2 ** 63:
            assert r.d == model_docs(r.s), r.s


def test_index_list_sizes_cover_every_vector(spark):
    sizes = E.queries()["I9_ivf_list_sizes"](spark, SF).collect()
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert sum(r.n for r in sizes) == n and min(r.n for r in sizes) == 0   # two lists are empty by design
    st_ = E.queries()["I8_ivf_stats"](spark, SF).first()
    assert st_.total_vectors == n and st_.min_cluster_size == 0


def test_scaling_targets_respect_policy(spark):
    d = E.queries()["M13_scaling_recommendations"](spark, SF)
    pol = E.queries()["M6_effective_policy"](spark, SF).select("namespace", "min_replicas", "max_replicas")
    acted = d.where(F.col("action") != "none").join(pol, "namespace")
    assert acted.where((F.col("target_replicas") < F.col("min_replicas")) |
                       (F.col("target_replicas") > F.col("max_replicas"))).count() == 0
    assert acted.where(F.col("target_replicas") == F.col("current_replicas")).count() == 0


def test_status_counts_show_every_stage(spark):
    rows = E.queries()["A4_report_status_counts"](spark, SF).collect()
    assert len(rows) == 10 and {r.status for r in rows if r.reports == 0} == {"gpu_configured"}
