"""Metric time series and scaling decisions: M1-M16.

Batch form: window functions over each namespace's samples (ordered by
(ts, id)); the cooldown gate and the replica state it feeds are a
sequential state machine per namespace, run as a sorted scan inside
tasks (``repartition`` + ``sortWithinPartitions`` + ``mapInArrow``) that
keeps only the current namespace's state in memory.  Stream form lives in
``quiver.streaming.scaler``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiver.session import ship_package
from quiver.operators.windows import DEFAULT_BUCKET_SECONDS, epoch_micros, range_history, rows_history

# Autoscaler defaults.
@dataclass(frozen=True)
class ScalerConfig:
    high_cpu: float = 70.0
    low_cpu: float = 30.0
    high_memory: float = 70.0
    low_memory: float = 30.0
    high_qps: float = 2000.0
    low_qps: float = 500.0
    high_disk: float = 80.0
    low_disk: float = 20.0
    scale_up_factor: float = 1.5
    scale_down_factor: float = 0.5
    min_replicas: int = 1
    max_replicas: int = 10
    scale_up_cooldown_s: int = 300
    scale_down_cooldown_s: int = 600
    history: int = 5


# The default user policy and load-class / trend limits.
DEFAULT_POLICY = {"enable_auto_scale_up": True, "enable_auto_scale_down": True, "scale_up_threshold": 70.0,
                  "scale_down_threshold": 30.0, "min_replicas": 1, "max_replicas": 10}
HIGH_LOAD, LOW_LOAD = 80.0, 20.0
TREND_LIMIT, QPS_TREND_LIMIT = 0.5, 10.0
RETENTION_DAYS = 15
METRICS = ("cpu_usage", "memory_usage", "disk_usage", "qps")
TREND = {"cpu_usage": "cpu_trend", "memory_usage": "memory_trend", "disk_usage": "disk_trend", "qps": "qps_trend"}
ADJ = {"cpu_usage": "adj_cpu", "memory_usage": "adj_memory", "disk_usage": "adj_disk", "qps": "adj_qps"}


def load_class(cpu: Column, mem: Column) -> Column:
    """M1."""
    return (F.when((cpu > HIGH_LOAD) | (mem > HIGH_LOAD), F.lit("high_load"))
            .when((cpu < LOW_LOAD) & (mem < LOW_LOAD), F.lit("low_load"))
            .otherwise(F.lit("normal")))


def status_refresh(latest: DataFrame, deployments: DataFrame) -> DataFrame:
    """M2: latest metrics + load class onto deployments; no deployment row -> skipped (inner join)."""
    j = deployments.join(latest, "namespace", "inner")
    return j.withColumn("load_class", load_class(F.col("cpu_usage"), F.col("memory_usage")))


def metric_history(metrics: DataFrame, cfg: ScalerConfig = ScalerConfig(),
                   bucket_seconds: int | None = DEFAULT_BUCKET_SECONDS) -> DataFrame:
    """M3: per sample, the size of its last-5 history and that history's first sample."""
    columns = lambda w: {"hist_n": F.count(F.lit(1)).over(w), "hist_first_id": F.first("id").over(w)}
    return rows_history(metrics, ["namespace"], ["ts", "id"], cfg.history, columns, bucket_seconds=bucket_seconds)


def metric_trend(metrics: DataFrame, cfg: ScalerConfig = ScalerConfig(),
                 bucket_seconds: int | None = DEFAULT_BUCKET_SECONDS) -> DataFrame:
    """M4: mean successive difference over the history = (last - first) / (n - 1); 0 if n < 2."""
    def columns(w):
        n = F.count(F.lit(1)).over(w)
        return {"hist_n": n, **{TREND[m]: F.when(n < 2, F.lit(0.0)).otherwise((F.col(m) - F.first(m).over(w)) / (n - 1)) for m in METRICS}}

    return rows_history(metrics, ["namespace"], ["ts", "id"], cfg.history, columns, bucket_seconds=bucket_seconds)


def trend_adjust(df: DataFrame) -> DataFrame:
    """M5: x1.1 on a rising trend, x0.9 on a falling one (qps uses +-10)."""
    out = df
    for m in METRICS:
        lim = QPS_TREND_LIMIT if m == "qps" else TREND_LIMIT
        t = F.col(TREND[m])
        out = out.withColumn(ADJ[m], F.when(t > lim, F.col(m) * 1.1).when(t < -lim, F.col(m) * 0.9).otherwise(F.col(m)))
    return out


def effective_policy(deployments: DataFrame, policies: DataFrame) -> DataFrame:
    """M6: the owner's policy, else the default policy."""
    p = policies.withColumn("has_policy", F.lit(True))
    j = deployments.join(p, "user_id", "left")
    cols = [F.coalesce(F.col(k), F.lit(v)).alias(k) for k, v in DEFAULT_POLICY.items()]
    return j.select(*[c for c in deployments.columns], *cols, F.coalesce("has_policy", F.lit(False)).alias("has_policy"))


def should_scale_up(df: DataFrame, per_resource: bool = False, cfg: ScalerConfig = ScalerConfig()) -> Column:
    """M7: any adjusted metric above the policy's single up threshold (or per-resource limits)."""
    if per_resource:
        return ((F.col("adj_cpu") > cfg.high_cpu) | (F.col("adj_memory") > cfg.high_memory)
                | (F.col("adj_disk") > cfg.high_disk) | (F.col("adj_qps") > cfg.high_qps))
    t = F.col("scale_up_threshold")
    return (F.col("adj_cpu") > t) | (F.col("adj_memory") > t) | (F.col("adj_disk") > t) | (F.col("adj_qps") > t)


def should_scale_down(df: DataFrame, per_resource: bool = False, cfg: ScalerConfig = ScalerConfig()) -> Column:
    """M8: every adjusted metric below the down threshold."""
    if per_resource:
        return ((F.col("adj_cpu") < cfg.low_cpu) & (F.col("adj_memory") < cfg.low_memory)
                & (F.col("adj_disk") < cfg.low_disk) & (F.col("adj_qps") < cfg.low_qps))
    t = F.col("scale_down_threshold")
    return (F.col("adj_cpu") < t) & (F.col("adj_memory") < t) & (F.col("adj_disk") < t) & (F.col("adj_qps") < t)


def target_replicas(cur: Column, up: Column, down: Column, cfg: ScalerConfig = ScalerConfig()) -> Column:
    """M9: up: floor(cur*1.5) capped at config max, at least cur+1; down: floor(cur*0.5),
    floored at config min, at most cur-1; up wins; else cur."""
    u = F.least(F.floor(cur * cfg.scale_up_factor), F.lit(cfg.max_replicas))
    u = F.when(u <= cur, cur + 1).otherwise(u)
    d = F.greatest(F.floor(cur * cfg.scale_down_factor), F.lit(cfg.min_replicas))
    d = F.when(d >= cur, cur - 1).otherwise(d)
    return F.when(up, u).when(down, d).otherwise(cur).cast("long")


def policy_clamp(target: Column, lo: Column, hi: Column) -> Column:
    """M10."""
    return F.greatest(F.least(target, hi), lo).cast("long")


def decision_inputs(metrics: DataFrame, deployments: DataFrame, policies: DataFrame, quota_ok: DataFrame | None,
                    per_resource: bool = False, cfg: ScalerConfig = ScalerConfig()) -> DataFrame:
    """M3-M8 + M6 + M12 inputs per sample: one row per (namespace, tick)."""
    pol = effective_policy(deployments, policies)
    adj = trend_adjust(metric_trend(metrics, cfg))
    j = adj.join(pol, "namespace", "inner")
    if quota_ok is not None:
        j = j.join(quota_ok.select(F.col("tenant_id").alias("user_id"), F.col("allowed").alias("quota_ok")), "user_id", "left")
    else:
        j = j.withColumn("quota_ok", F.lit(None).cast("boolean"))
    up = F.col("enable_auto_scale_up") & should_scale_up(j, per_resource, cfg)
    down = F.col("enable_auto_scale_down") & should_scale_down(j, per_resource, cfg)
    return j.withColumn("want_up", up).withColumn("want_down", down)


def target_of(cur: int, up: bool, down: bool, cfg: ScalerConfig) -> int:
    """M9 for one tick (Go-style truncation of the scaled count)."""
    if up:
        t = min(int(cur * cfg.scale_up_factor), cfg.max_replicas)
        return cur + 1 if t <= cur else t
    if down:
        t = max(int(cur * cfg.scale_down_factor), cfg.min_replicas)
        return cur - 1 if t >= cur else t
    return cur


def decide(cur: int, last_us, ts_us: int, en_up, en_down, want_up, want_down, min_r: int, max_r: int, user,
           quota_ok, cfg: ScalerConfig, parity_noop: bool = False):
    """One tick of M9-M12: returns (target, action, reason, executed)."""
    if not (en_up or en_down):
        return cur, "none", "autoscaling disabled", False
    tgt = target_of(cur, bool(want_up), bool(want_down), cfg)
    if tgt == cur:
        return cur, "none", "no change", False
    cool = cfg.scale_up_cooldown_s if tgt > cur else cfg.scale_down_cooldown_s
    if last_us is not None and ts_us - last_us < cool * 1_000_000:
        return tgt, "none", "cooldown", False
    tgt = max(min(tgt, int(max_r)), int(min_r))
    if tgt > cur and user not in (None, "") and quota_ok is False:
        return tgt, "none", "quota exceeded", False
    if tgt == cur and not parity_noop:
        return tgt, "none", "at policy limit", False
    action = "scale_up" if tgt > cur else ("scale_down" if tgt < cur else "noop_scale")
    return tgt, action, "executed", True


_SCAN_COLS = ("namespace", "id", "ts_us", "replicas", "user_id", "want_up", "want_down", "enable_auto_scale_up",
              "enable_auto_scale_down", "min_replicas", "max_replicas", "quota_ok")


def _scan(cfg: ScalerConfig, parity_noop: bool, static_current: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ns_cur, replicas, last = None, 0, None
        for b in batches:
            if b.num_rows == 0:
                continue
            d = {n: b.column(n).to_pylist() for n in _SCAN_COLS}
            n = b.num_rows
            o_cur, o_tgt, o_act, o_rsn = [0] * n, [0] * n, [None] * n, [None] * n
            for i in range(n):
                if d["namespace"][i] != ns_cur:
                    ns_cur, replicas, last = d["namespace"][i], int(d["replicas"][i]), None
                cur = int(d["replicas"][i]) if static_current else replicas
                ts = int(d["ts_us"][i])
                tgt, act, rsn, done = decide(cur, last, ts, d["enable_auto_scale_up"][i], d["enable_auto_scale_down"][i],
                                             d["want_up"][i], d["want_down"][i], d["min_replicas"][i],
                                             d["max_replicas"][i], d["user_id"][i], d["quota_ok"][i], cfg, parity_noop)
                o_cur[i], o_tgt[i], o_act[i], o_rsn[i] = cur, tgt, act, rsn
                if done:
                    last = ts
                    if not static_current:
                        replicas = tgt
            yield pa.RecordBatch.from_arrays(
                [b.column("namespace"), b.column("id"), b.column("ts"), pa.array(o_cur, pa.int64()),
                 pa.array(o_tgt, pa.int64()), pa.array(o_act, pa.string()), pa.array(o_rsn, pa.string())],
                names=["namespace", "id", "ts", "current_replicas", "target_replicas", "action", "reason"])

    return run


def scaling_scan(inputs: DataFrame, cfg: ScalerConfig = ScalerConfig(), parity_noop: bool = False,
                 static_current: bool = False, partitions: int | None = None) -> DataFrame:
    """M11 + M13: the per-namespace state machine (cooldown, replica count) over sorted ticks.

    Memory per task is one namespace's state; the sort spills like any Spark sort.
    """
    ship_package(inputs.sparkSession)
    cols = ["namespace", "id", "ts", "replicas", "user_id", "want_up", "want_down", "enable_auto_scale_up",
            "enable_auto_scale_down", "min_replicas", "max_replicas", "quota_ok"]
    src = inputs.select(*cols, epoch_micros(F.col("ts")).alias("ts_us")) \
        .withColumn("replicas", F.col("replicas").cast("long")) \
        .withColumn("min_replicas", F.col("min_replicas").cast("long")) \
        .withColumn("max_replicas", F.col("max_replicas").cast("long"))
    # No explicit count unless asked: AQE then sizes (coalesces) the partitions.
    parted = src.repartition(partitions, "namespace") if partitions else src.repartition("namespace")
    ordered = parted.sortWithinPartitions("namespace", "ts", "id")
    ts_type = dict(inputs.dtypes)["ts"]
    schema = (f"namespace string, id long, ts {ts_type}, current_replicas long, target_replicas long, "
              "action string, reason string")
    return ordered.mapInArrow(_scan(cfg, parity_noop, static_current), schema)


def metric_retention(metrics: DataFrame, days: int = RETENTION_DAYS) -> DataFrame:
    """Keep samples newer than (latest sample - days)."""
    newest = metrics.agg(F.max("ts")).scalar()
    return metrics.where(F.col("ts") >= newest - F.expr(f"INTERVAL {days} DAYS"))


def counter_rate(counters: DataFrame, seconds: int = 300, key: str = "namespace",
                 bucket_seconds: int | None = DEFAULT_BUCKET_SECONDS) -> DataFrame:
    """Per-second increase of a counter over a look-back range, reset-aware, no extrapolation.

    inc_i = c_i - c_{i-1}, or c_i after a reset (c_i < c_{i-1}); the rate at a
    sample sums the increments inside [t - seconds, t] except the first one
    (whose other end lies outside) and divides by the covered span.  Windows
    run per (key, time bucket) with a ``seconds`` halo, so a hot key is split.
    """
    ext = range_history(counters, [key], "ts", seconds,
                        None if bucket_seconds is None else max(bucket_seconds, seconds))
    w = Window.partitionBy(key, "_b").orderBy("ts", "id")
    prev = F.lag("counter").over(w)
    inc = F.when(prev.isNull(), F.lit(0)).when(F.col("counter") < prev, F.col("counter")).otherwise(F.col("counter") - prev)
    df = ext.withColumn("_inc", inc.cast("double")).withColumn("_s", epoch_micros(F.col("ts")) / 1_000_000.0)
    rw = Window.partitionBy(key, "_b").orderBy("_s").rangeBetween(-seconds, 0)
    span = F.col("_s") - F.min("_s").over(rw)
    # the first sample of the range by (ts, id), so that equal times have one answer
    total = F.sum("_inc").over(rw) - F.min_by("_inc", F.struct("_s", "id")).over(rw)
    out = df.withColumn("rate", F.when(span > 0, total / span))
    return out.where("_own").drop("_inc", "_s", "_own", "_b")


def disk_used_pct(df: DataFrame, size_col: str = "size_bytes", avail_col: str = "avail_bytes") -> Column:
    """(1 - avail / size) * 100."""
    return (F.lit(1.0) - F.col(avail_col) / F.col(size_col)) * 100.0
