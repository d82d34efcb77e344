"""M3-M13 as a stateful stream: per namespace, keyed state holds the last five
samples, the replica count and the last action time (``applyInPandasWithState``)."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quiver.session import ship_package
from quiver.operators.scaling import METRICS, QPS_TREND_LIMIT, TREND_LIMIT, ScalerConfig, decide, epoch_micros

# pandas concat inside the state serializer warns about all-NA columns; harmless here
warnings.filterwarnings("ignore", category=FutureWarning, module="pyspark.sql.pandas.serializers")

STATE_SCHEMA = ("replicas long, last_us long, seen_us long, seen_id long, h_cpu_usage array<double>, "
                "h_memory_usage array<double>, h_disk_usage array<double>, h_qps array<double>")
OUT_SCHEMA = ("namespace string, id long, ts timestamp_ntz, current_replicas long, target_replicas long, "
              "action string, reason string")


def _adjust(v: float, hist: list, limit: float) -> float:
    n = len(hist)
    trend = 0.0 if n < 2 else (hist[-1] - hist[0]) / (n - 1)
    if trend > limit:
        return v * 1.1
    if trend < -limit:
        return v * 0.9
    return v


def _handler(cfg: ScalerConfig, parity_noop: bool):
    def handle(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(pdfs), ignore_index=True).sort_values(["ts_us", "id"], kind="stable")
        if state.exists:
            replicas, last, seen_us, seen_id, *h = state.get
            hist = {m: list(x) for m, x in zip(METRICS, h)}
            last = None if last is None or last < 0 else last
        else:
            replicas, last, seen_us, seen_id = int(pdf["replicas"].iloc[0]), None, None, None
            hist = {m: [] for m in METRICS}
        out = []
        for r in pdf.itertuples(index=False):
            ts = int(r.ts_us)
            if seen_us is not None and (ts, int(r.id)) <= (seen_us, seen_id):
                out.append((r.namespace, int(r.id), r.ts, replicas, replicas, "none", "late sample"))
                continue
            seen_us, seen_id = ts, int(r.id)
            adj = {}
            for m in METRICS:
                hist[m] = (hist[m] + [float(getattr(r, m))])[-cfg.history:]
                adj[m] = _adjust(float(getattr(r, m)), hist[m], QPS_TREND_LIMIT if m == "qps" else TREND_LIMIT)
            up_t, down_t = float(r.scale_up_threshold), float(r.scale_down_threshold)
            want_up = bool(r.enable_auto_scale_up) and any(adj[m] > up_t for m in METRICS)
            want_down = bool(r.enable_auto_scale_down) and all(adj[m] < down_t for m in METRICS)
            q = None if pd.isna(r.quota_ok) else bool(r.quota_ok)
            tgt, act, rsn, done = decide(replicas, last, ts, bool(r.enable_auto_scale_up), bool(r.enable_auto_scale_down),
                                         want_up, want_down, int(r.min_replicas), int(r.max_replicas), r.user_id, q,
                                         cfg, parity_noop)
            out.append((r.namespace, int(r.id), r.ts, replicas, tgt, act, rsn))
            if done:
                last, replicas = ts, tgt
        state.update((replicas, -1 if last is None else last, seen_us, seen_id,
                      *[hist[m] for m in METRICS]))
        yield pd.DataFrame(out, columns=["namespace", "id", "ts", "current_replicas", "target_replicas", "action", "reason"])

    return handle


def scaling_stream(metrics: DataFrame, namespace_inputs: DataFrame, cfg: ScalerConfig = ScalerConfig(),
                   parity_noop: bool = False) -> DataFrame:
    """Streaming M13: ``metrics`` is a stream of samples; ``namespace_inputs`` the static
    per-namespace deployment, effective policy and quota flag (stream-static join)."""
    ship_package(metrics.sparkSession)
    j = metrics.join(namespace_inputs, "namespace").withColumn("ts_us", epoch_micros(F.col("ts")))
    return j.groupBy("namespace").applyInPandasWithState(
        _handler(cfg, parity_noop), OUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)
