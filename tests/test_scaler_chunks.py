"""The composed state machine against a sequential one."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quiver.operators import scaler_chunks as S
from quiver.operators.scaling import ScalerConfig, decide, scaling_scan

CFG = ScalerConfig()
COLUMNS = ("namespace string, id long, ts timestamp_ntz, replicas int, user_id string, want_up boolean, want_down boolean, "
           "enable_auto_scale_up boolean, enable_auto_scale_down boolean, min_replicas int, max_replicas int, quota_ok boolean")


def history(seed, n, gap, namespaces=("a",), policy=None):
    """Random ticks ``gap`` seconds apart on average, some at equal times; namespaces differ in policy."""
    rnd = random.Random(seed)
    rows, i = [], 0
    for ns in namespaces:
        t = rnd.randint(0, 10_000)
        lo, hi = policy or (rnd.randint(1, 3), rnd.randint(3, 12))
        start, user, on = rnd.randint(1, 10), rnd.choice(["u", "", None]), bool(policy) or rnd.random() < 0.9
        lean = 1.0 if policy else rnd.random()
        for _ in range(n):
            t += rnd.choice([0, 1, gap, 2 * gap]) if gap else rnd.choice([0, 0, 1])
            up, down = rnd.random() < 0.4 * lean, rnd.random() < 0.4
            ts = np.datetime64("2024-01-01") + np.timedelta64(t, "s")
            rows.append((ns, i, ts.astype("datetime64[us]").item(), start, user, up, down and not up, on, on and rnd.random() < 0.95, lo, hi,
                         rnd.choice([True, True, False, None])))
            i += 1
    rnd.shuffle(rows)
    return rows


def decided(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("static", [False, True])
@pytest.mark.parametrize("gap, target_rows, fan_in", [(40, 7, 2), (40, 7, 64), (200, 5, 3), (0, 9, 2), (3, 25, 4), (40, 10_000, 64)])
def test_equals_the_sequential_scan(spark, gap, target_rows, fan_in, static):
    rows = history(gap + target_rows, 150, gap, ("a", "b", "c")) + history(1, 4, 30, ("tiny",))
    df = spark.createDataFrame(rows, COLUMNS)
    for parity in (False, True):
        want = scaling_scan(df, CFG, parity_noop=parity, static_current=static)
        got = S.scaling_scan_chunked(df, CFG, parity_noop=parity, static_current=static, target_rows=target_rows, fan_in=fan_in)
        assert decided(got) == decided(want)


def test_other_cooldowns_and_busy_spans(spark):
    """Chunks far shorter than a cooldown: states are handed on through several that do not act."""
    cfg = ScalerConfig(scale_up_cooldown_s=900, scale_down_cooldown_s=120)
    df = spark.createDataFrame(history(5, 400, 10, ("a", "b"), policy=(1, 10)), COLUMNS)
    want = decided(scaling_scan(df, cfg))
    assert {r[5] for r in want} >= {"none", "scale_up", "scale_down"}
    assert decided(S.scaling_scan_chunked(df, cfg, target_rows=20, fan_in=2)) == want


def test_no_rows(spark):
    assert S.scaling_scan_chunked(spark.createDataFrame([], COLUMNS)).count() == 0


def chunk(rows):
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    table = pa.table({n: pa.array(list(c)) for n, c in zip(names, zip(*rows))})
    us = [int(np.datetime64(r[2], "us").astype("int64")) for r in rows]
    return table.append_column("ts_us", pa.array(us, pa.int64()))


def stepped_through(ticks, r, last, cfg=CFG):
    for t in ticks:
        tgt, _, _, done = decide(r, None if last == S.NONE else last, int(np.datetime64(t[2], "us").astype("int64")), t[7], t[8], t[5], t[6], t[9], t[10], t[4], t[11], cfg)
        if done:
            r, last = tgt, int(np.datetime64(t[2], "us").astype("int64"))
    return r, last


@pytest.mark.parametrize("gap", [0, 2, 40, 400])
def test_maps_and_their_composition(gap):
    """Maps evaluated at every second before a chunk, and composed in either order, equal stepping."""
    rows = sorted(history(gap, 60, gap, policy=(1, 6)), key=lambda r: (r[2], r[1]))
    rows = [(*r[:3], 3, "u", *r[5:]) for r in rows]
    parts = [rows[:13], rows[13:30], rows[30:34], rows[34:]]
    counts = list(range(1, 7))
    maps = [dict(zip(counts, S.Actions(S.Ticks.of(chunk(p), CFG, False, False)[0], counts).map())) for p in parts]
    left = {r: S.composed(S.composed(m, r, maps[1]), r, maps[2]) for r, m in maps[0].items()}
    tail = {r: S.composed(m, r, maps[2]) for r, m in maps[1].items()}
    right = {r: S.composed(m, r, tail) for r, m in maps[0].items()}
    begin = int(np.datetime64(rows[0][2], "us").astype("int64"))
    lasts = [S.NONE, *range(begin - 700_000_000, begin + 1, 7_000_000), begin]
    for r in counts:
        for k, m in enumerate(maps[:1]):
            got = [S.through(m, np.array([r] * len(lasts)), np.array(lasts, np.int64))]
            want = [stepped_through(parts[k], r, last) for last in lasts]
            assert list(zip(got[0][0].tolist(), got[0][1].tolist())) == want
        want = [stepped_through(rows[:34], r, last) for last in lasts]
        for m in (left, right):
            out = S.through(m, np.array([r] * len(lasts)), np.array(lasts, np.int64))
            assert list(zip(out[0].tolist(), out[1].tolist())) == want


def test_a_chunk_is_not_stepped_through(monkeypatch):
    """A hundred thousand ticks of a quiet cooldown take few lookups."""
    n = 100_000
    ones = np.ones(n, bool)
    ticks = S.Ticks(np.arange(n) * 50_000, np.full(n, 3), ones, ones, ~ones, np.full(n, 1), np.full(n, 10), ~ones, CFG, False, False)
    calls, first = [], S.Actions.first
    monkeypatch.setattr(S.Actions, "first", lambda self, *a: calls.append(1) or first(self, *a))
    actions = S.Actions(ticks, list(range(1, 11)))
    at, to = actions.taken(3, S.NONE)
    assert to == [4, 6, 9, 10] and [int(ticks.ts[i]) // 1_000_000 for i in at] == [0, 300, 600, 900] and len(calls) == 5
    assert len(actions.map()) == 10 and len(calls) == 25
