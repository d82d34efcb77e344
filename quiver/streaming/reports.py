"""A7 as an event-time stream: per-index, per-tick QPS and latency percentiles.

A watermark bounds the window state: once the watermark passes a tick's end,
the tick is evicted from state and rows that arrive for it later are dropped
(rows within the watermark delay are always counted).  Update mode emits each
window's new aggregate whenever it changes; the sink keeps the latest version
per (index, window).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.operators.reports import PERCENTILE_ACCURACY, REPORT_TICK
from quiver.operators.windows import epoch_micros


def qps_latency_stream(search_log: DataFrame, watermark: str = "10 minutes", key: str = "index_name",
                       tick: str = REPORT_TICK, tick_seconds: int = 60) -> DataFrame:
    # watermarks need TIMESTAMP: read the NTZ wall time as UTC (no session time zone involved)
    src = search_log.withColumn("_et", F.timestamp_micros(epoch_micros(F.col("ts"))))
    g = src.withWatermark("_et", watermark).groupBy(key, F.window("_et", tick).alias("w")).agg(
        F.count(F.lit(1)).alias("queries"),
        F.avg("latency_ms").alias("avg_latency"),
        F.percentile_approx("latency_ms", 0.95, PERCENTILE_ACCURACY).alias("p95_latency"),
        F.percentile_approx("latency_ms", 0.99, PERCENTILE_ACCURACY).alias("p99_latency"))
    start = F.timestamp_add("MICROSECOND", F.unix_micros(F.col("w.start")),
                            F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return g.select(key, start.alias("window_start"), "queries",
                    F.round(F.col("queries") / F.lit(float(tick_seconds)), 6).alias("qps"),
                    F.round("avg_latency", 6).alias("avg_latency"), "p95_latency", "p99_latency")
