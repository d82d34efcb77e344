"""Event-time behaviour of the watermarked QPS stream and of the multi-line log stream."""

import datetime as dt
import random

import pytest

from quiver.operators.logs import multiline_records
from quiver.operators.tenants import latest_per_key
from quiver.session import scratch_path
from quiver.plans.stream_plans import state_partitions
from quiver.streaming import ingest
from quiver.streaming.logs import STATE_STORE, multiline_stream
from quiver.streaming.reports import qps_latency_stream
from quiver.streaming.sources import idempotent_batch_writer


def test_rows_behind_an_evicted_window_are_dropped(spark):
    schema = "query_id long, index_name string, latency_ms double, ts timestamp_ntz"
    t0 = dt.datetime(2024, 1, 1, 12, 0, 0)
    files = [
        [(1, "idx-1", 10.0, t0), (2, "idx-1", 20.0, t0 + dt.timedelta(seconds=30)),
         (3, "idx-1", 30.0, t0 + dt.timedelta(minutes=30))],                # watermark -> 12:29
        [(5, "idx-1", 40.0, t0 + dt.timedelta(minutes=30, seconds=5))],     # window 12:00 evicted here
        [(4, "idx-1", 99.0, t0 + dt.timedelta(seconds=10))],                # 30 min late: dropped
    ]
    base = scratch_path(spark, "test-watermark")
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
    src = ingest.read_stream(spark, f"{base}/in", spark.createDataFrame([], schema).schema)
    q = qps_latency_stream(src, watermark="1 minute").writeStream \
        .foreachBatch(idempotent_batch_writer(f"{base}/out", [])) \
        .option("checkpointLocation", f"{base}/ckpt").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    dropped = sum(op.get("numRowsDroppedByWatermark", 0) for p in q.recentProgress for op in p.get("stateOperators", []))
    assert dropped == 1
    out = latest_per_key(spark.read.parquet(f"{base}/out"), ["index_name", "window_start"], ["batch_id"])
    got = {r.window_start: (r.queries, r.avg_latency) for r in out.collect()}
    assert got[t0] == (2, 15.0)
    assert got[t0 + dt.timedelta(minutes=30)] == (2, 35.0)


@pytest.mark.parametrize("seed", range(2))
def test_late_and_shuffled_log_lines_give_the_batch_records(spark, seed):
    """Two files; lines arrive out of order within the delay, some twice, with pauses between the batches."""
    rnd = random.Random(seed)
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for file in ("a", "b"):
        seconds = 0
        for n in range(60):
            seconds += rnd.choice([0, 1, 5, 300])
            raw = f"2024-01-0{rnd.randint(1, 9)} {file}{n}" if n and rnd.random() < 0.4 else f"  at {file}{n}"
            rows.append((file, n, raw, t0 + dt.timedelta(seconds=seconds)))
    arrival = sorted(rows, key=lambda r: (r[3] + dt.timedelta(seconds=rnd.randint(0, 550)), r))
    cuts = sorted(rnd.sample(range(1, len(arrival)), 5))
    files = [arrival[a:b] + rnd.sample(arrival[a:b], 1) for a, b in zip([0, *cuts], [*cuts, len(arrival)])]
    files += [[(f, None, None, t0 + dt.timedelta(days=9))] for f in ("a", "b")]
    schema = "file string, line_no long, raw string, ts timestamp"
    base = scratch_path(spark, "test-multiline")
    for part in files:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
    src = ingest.read_stream(spark, f"{base}/in", spark.createDataFrame([], schema).schema)
    with pytest.raises(RuntimeError, match="providerClass"):
        multiline_stream(src)
    with state_partitions(spark, STATE_STORE):
        q = multiline_stream(src, delay="10 minutes").writeStream.foreachBatch(idempotent_batch_writer(f"{base}/out", [])) \
            .option("checkpointLocation", f"{base}/ckpt").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    got = spark.read.parquet(f"{base}/out").select("file", "record_start", "lines", "text").collect()
    want = multiline_records(spark.createDataFrame(rows, schema), file_cols=["file"]).select("file", "record_start", "lines", "text").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_log_lines_are_held_in_buckets_and_records_cross_them(spark):
    """Records of many buckets, negative line numbers, a long pause inside a record; few state entries for many lines."""
    rnd = random.Random(5)
    t0 = dt.datetime(2024, 1, 1)
    rows, seconds = [], 0
    for n in range(-30, 400):
        seconds += 7200 if n in (50, 333) else rnd.choice([0, 1, 5])
        raw = f"2024-01-01 {n}" if n in (0, 1, 100, 333) or 200 < n < 300 and rnd.random() < 0.5 else f"  at {n}"
        rows.append(("a", n, raw, t0 + dt.timedelta(seconds=seconds)))
    late = [r for r in rows if r[1] % 17 == 0]
    files = [[r for r in rows if r[1] % 17 and r[1] < 150], [r for r in rows if r[1] % 17 and r[1] >= 150], late, [("a", None, None, t0 + dt.timedelta(days=9))]]
    schema = "file string, line_no long, raw string, ts timestamp"
    base = scratch_path(spark, "test-buckets")
    for part in files:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
    src = ingest.read_stream(spark, f"{base}/in", spark.createDataFrame([], schema).schema)
    with state_partitions(spark, STATE_STORE):
        q = multiline_stream(src, delay="6 hours", bucket_lines=25).writeStream.foreachBatch(idempotent_batch_writer(f"{base}/out", [])) \
            .option("checkpointLocation", f"{base}/ckpt").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    assert q.exception() is None
    held = max(sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in q.recentProgress if p["stateOperators"])
    assert held < len(rows) / 2
    got = spark.read.parquet(f"{base}/out").select("file", "record_start", "lines", "text").collect()
    want = multiline_records(spark.createDataFrame(rows, schema), file_cols=["file"]).select("file", "record_start", "lines", "text").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert max(r["lines"] for r in got) > 75
