"""Bucketed per-key windows equal the plain per-key windows (incl. a hot key and sparse buckets)."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quiver.operators.windows import descending_position, range_history, rows_history

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def skewed(spark):
    e = spark.read.parquet(f"{SF}/events.parquet")
    # a third of the rows share one key
    key = F.when(F.col("event_id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("user_id") % 7).cast("string")))
    return e.select(key.alias("k"), F.col("event_id").alias("id"), "ts", "value").cache()


def frame_columns(w):
    return {"n": F.count(F.lit(1)).over(w), "f": F.first("value").over(w)}


@pytest.mark.parametrize("bucket", [60, 3600, 86400 * 3, None])
def test_rows_history_equals_plain_window(skewed, bucket):
    got = rows_history(skewed, ["k"], ["ts", "id"], 5, frame_columns, bucket_seconds=bucket).select("k", "id", "n", "f")
    pw = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(-4, 0)
    want = skewed.select("k", "id", F.count(F.lit(1)).over(pw).alias("n"), F.first("value").over(pw).alias("f"))
    assert sorted(got.collect()) == sorted(want.collect())


@pytest.mark.parametrize("bucket", [300, 7200, None])
def test_range_history_equals_plain_window(skewed, bucket):
    secs = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    ext = range_history(skewed, ["k"], "ts", 300, bucket).withColumn("_s", secs)
    rw = Window.partitionBy("k", "_b").orderBy("_s").rangeBetween(-300, 0)
    got = ext.select("k", "id", F.sum("value").over(rw).alias("s"), F.count(F.lit(1)).over(rw).alias("n"), "_own") \
        .where("_own").drop("_own")
    pw = Window.partitionBy("k").orderBy("_s").rangeBetween(-300, 0)
    want = skewed.withColumn("_s", secs).select("k", "id", F.sum("value").over(pw).alias("s"),
                                                F.count(F.lit(1)).over(pw).alias("n"))
    key = lambda r: (r.k, r.id)
    g, wnt = sorted(got.collect(), key=key), sorted(want.collect(), key=key)
    assert [(r.k, r.id, r.n) for r in g] == [(r.k, r.id, r.n) for r in wnt]
    assert all(abs(a.s - b.s) < 1e-6 for a, b in zip(g, wnt))


def test_descending_position(skewed):
    got = descending_position(skewed, ["k"], "ts", "id", bucket_seconds=600).select("k", "id", "position")
    pw = Window.partitionBy("k").orderBy(F.col("ts").desc(), F.col("id").desc())
    want = skewed.select("k", "id", F.row_number().over(pw).alias("position"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_adaptive_buckets_split_hot_key(spark, skewed, monkeypatch):
    import quiver.operators.windows as W

    monkeypatch.setattr(W, "TARGET_BUCKET_ROWS", 25)
    widths = {r.k: r._bw for r in W.with_bucket_width(skewed, ["k"], "ts", None).select("k", "_bw").distinct().collect()}
    assert widths["hot"] < min(v for k, v in widths.items() if k != "hot")   # the hot key gets the narrowest buckets
    got = W.rows_history(skewed, ["k"], ["ts", "id"], 5, frame_columns).select("k", "id", "n", "f")
    pw = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(-4, 0)
    want = skewed.select("k", "id", F.count(F.lit(1)).over(pw).alias("n"), F.first("value").over(pw).alias("f"))
    assert sorted(got.collect()) == sorted(want.collect())
    secs = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    ext = W.range_history(skewed, ["k"], "ts", 300).withColumn("_s", secs)
    rw = Window.partitionBy("k", "_b").orderBy("_s").rangeBetween(-300, 0)
    got = ext.select("k", "id", F.count(F.lit(1)).over(rw).alias("n"), "_own").where("_own").drop("_own")
    pw = Window.partitionBy("k").orderBy("_s").rangeBetween(-300, 0)
    want = skewed.withColumn("_s", secs).select("k", "id", F.count(F.lit(1)).over(pw).alias("n"))
    assert sorted(got.collect()) == sorted(want.collect())
    got = W.descending_position(skewed, ["k"], "ts", "id").select("k", "id", "position")
    want = skewed.select("k", "id", F.row_number().over(
        Window.partitionBy("k").orderBy(F.col("ts").desc(), F.col("id").desc())).alias("position"))
    assert sorted(got.collect()) == sorted(want.collect())


@pytest.mark.parametrize("n", [1, 2, 7])
def test_rows_history_with_null_keys_and_times(spark, n):
    rows = [(k, i, None if i % 9 == 0 else f"2024-01-01 {i % 24:02}:{i % 60:02}:00") for i in range(120) for k in [("a", None, "b")[i % 3]]]
    df = spark.createDataFrame(rows, "k string, id long, t string").selectExpr("k", "id", "cast(t as timestamp_ntz) as ts", "id * 2 as value")
    got = rows_history(df, ["k"], ["ts", "id"], n, frame_columns, bucket_seconds=3600).select("k", "id", "n", "f")
    pw = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(1 - n, 0)
    want = df.select("k", "id", F.count(F.lit(1)).over(pw).alias("n"), F.first("value").over(pw).alias("f"))
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_rows_history_exchanges_the_data_once(spark):
    """Two scans (bucket widths, rows) and one exchange of the rows."""
    e = spark.read.parquet(f"{SF}/events.parquet").select(F.col("user_id").alias("k"), F.col("event_id").alias("id"), "ts", "value")
    out = rows_history(e, ["k"], ["ts", "id"], 5, frame_columns)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    reused = [line for line in final.splitlines() if "ReusedExchange" in line]
    stages = [line for line in final.splitlines() if "Exchange hashpartitioning(k" in line and "_b" in line and line not in reused]
    assert len(stages) == 1 and reused
