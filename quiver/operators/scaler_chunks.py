"""The scaling state machine (M11, M13) over pieces of a namespace's history.

Between two executed actions the state - replicas and the time of the last action -
does not change, and a cooldown of minutes follows every action.  So the ticks
are never stepped through: for every replica count, columns tell which ticks would
act if no cooldown held (*eligible* ticks); the action after a given state is the
first eligible tick past the cooldown, one lookup away; and once the actions are
known, every tick's decision is again a column expression of the state it finds.

A namespace of any length is cut into chunks of about ``target_rows`` ticks, by
time, also inside a busy minute.  What a chunk does is a *map* from the state that enters
it to the state that leaves it.  For one replica count it is a step function of the last
action's time: up to each bound the chunk acts first at a certain tick, and from
there on its way is known; above the last bound it does not act and hands the state
on.  Maps compose, so entry states are found by a tree: groups of ``FAN_IN`` chunks
are composed, and groups of groups, until few are left; then the states are handed
down again.  No task ever holds more than a chunk or one group's maps.

1. per chunk: its map (numpy, by following all actions at once);
2. tree of compositions, and the entry state of every chunk;
3. per chunk: its actions from the entry state, and every tick's decision.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiver.operators.scaling import ScalerConfig
from quiver.operators.windows import epoch_micros
from quiver.session import scratch_path, ship_package

#: Times of the last action: none yet, and the upper end of every map.
NONE, EVER = -(2 ** 62), 2 ** 62
SPAN = 600  # seconds: spans in which ticks are counted; busier ones are cut further
FAN_IN = 64

_IN_COLS = ["namespace", "id", "ts", "replicas", "user_id", "want_up", "want_down", "enable_auto_scale_up",
            "enable_auto_scale_down", "min_replicas", "max_replicas", "quota_ok"]
_MAP_SCHEMA = "namespace string, chunk long, e_r long, hi array<long>, x_r array<long>, x_l array<long>, init long"
_ENTRY_SCHEMA = "namespace string, chunk long, in_r long, in_l long"
ACTIONS = ("none", "scale_up", "scale_down", "noop_scale")
REASONS = ("autoscaling disabled", "no change", "cooldown", "quota exceeded", "at policy limit", "executed")


@dataclass
class Ticks:
    """The columns of a chunk's ticks in order, and what they decide."""

    ts: np.ndarray
    replicas: np.ndarray
    enabled: np.ndarray
    up: np.ndarray
    down: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    no_quota: np.ndarray
    cfg: ScalerConfig
    parity: bool
    static: bool

    @classmethod
    def of(cls, table: pa.Table, cfg: ScalerConfig, parity: bool, static: bool) -> tuple["Ticks", pa.Table]:
        table = table.sort_by([("ts_us", "ascending"), ("id", "ascending")])
        flag = lambda c: pc.fill_null(table.column(c), False).to_numpy()
        number = lambda c: table.column(c).to_numpy()
        user = pc.not_equal(pc.fill_null(table.column("user_id"), ""), "").to_numpy()
        refused = pc.invert(pc.fill_null(table.column("quota_ok"), True)).to_numpy()
        return cls(number("ts_us"), number("replicas"), flag("enable_auto_scale_up") | flag("enable_auto_scale_down"), flag("want_up"), flag("want_down"),
                   number("min_replicas"), number("max_replicas"), user & refused, cfg, parity, static), table

    def targets(self, cur: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The replicas wanted at ``cur``, and those within the policy."""
        more = np.minimum((cur * self.cfg.scale_up_factor).astype(np.int64), self.cfg.max_replicas)
        less = np.maximum((cur * self.cfg.scale_down_factor).astype(np.int64), self.cfg.min_replicas)
        want = np.where(self.up, np.where(more <= cur, cur + 1, more), np.where(self.down, np.where(less >= cur, cur - 1, less), cur))
        return want, np.maximum(np.minimum(want, self.hi), self.lo)

    def decide(self, cur: np.ndarray, cooling: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(target, action, reason) of every tick that finds ``cur`` replicas; ``cooling``: the last action holds it back."""
        want, within = self.targets(cur)
        steps = [~self.enabled, want == cur, cooling, (within > cur) & self.no_quota, (within == cur) & (not self.parity)]
        reason = np.select(steps, range(len(steps)), len(steps))
        target = np.select(steps[:3], [cur, cur, want], within)
        action = np.where(reason < len(steps), 0, np.where(within > cur, 1, np.where(within < cur, 2, 3)))
        return target, action, reason

    def cooldown(self, cur: np.ndarray) -> np.ndarray:
        """Microseconds that a tick which finds ``cur`` replicas has to keep from the last action."""
        return np.where(self.targets(cur)[0] > cur, self.cfg.scale_up_cooldown_s, self.cfg.scale_down_cooldown_s) * 1_000_000


class Actions:
    """For each replica count the eligible ticks, and from any state the next action."""

    def __init__(self, ticks: Ticks, counts: list[int]):
        self.ticks, self.counts, n = ticks, counts, len(ticks.ts)
        self.place = {r: k for k, r in enumerate(counts)}
        self.cools = sorted({ticks.cfg.scale_up_cooldown_s * 1_000_000, ticks.cfg.scale_down_cooldown_s * 1_000_000})
        self.eligible, self.after, self.next = [], [], []
        for r in counts:
            cur = ticks.replicas if ticks.static else np.full(n, r, np.int64)
            target, _, reason = ticks.decide(cur, np.zeros(n, bool))
            cool = np.where(reason == len(REASONS) - 1, ticks.cooldown(cur), -1)
            self.eligible.append(cool)
            self.after.append(np.full(n, r, np.int64) if ticks.static else target)
            # per cooldown the first eligible tick from each place on; n: none
            at = [np.where(cool == c, np.arange(n), n) for c in self.cools]
            self.next.append([np.append(np.minimum.accumulate(x[::-1])[::-1], n) for x in at])

    def first(self, r: int, last: np.ndarray, since: np.ndarray) -> np.ndarray:
        """The tick of the next action from (``r``, each ``last``), not before place ``since``; n: none."""
        out = np.full(len(last), len(self.ticks.ts))
        for cool, upcoming in zip(self.cools, self.next[self.place[r]]):
            out = np.minimum(out, upcoming[np.maximum(np.searchsorted(self.ticks.ts, last + cool, "left"), since)])
        return out

    def map(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per count (bounds on the last action's time, replicas left with, time of the last action left with - EVER: as entered)."""
        ts, n, m = self.ticks.ts, len(self.ticks.ts), len(self.counts)
        # state k * n + i: counts[k] replicas after an action at tick i; each points to the next action's
        state = np.arange(m * n)
        for k, r in enumerate(self.counts):
            to = self.first(r, ts, np.arange(1, n + 1))
            acts = to < n
            state[k * n + np.flatnonzero(acts)] = self._state(self.after[k][to[acts]], to[acts])
        while True:
            further = state[state]
            if (further == state).all():
                break
            state = further
        out = []
        for k, r in enumerate(self.counts):
            cool = self.eligible[k]
            bound = (ts - cool)[(cool >= 0) & (ts - cool < ts[0])]
            bound = np.append(np.unique(bound), ts[0])
            to = self.first(r, bound, np.zeros(len(bound), np.int64))
            acts = to < n
            end = state[self._state(self.after[k][to[acts]], to[acts])]
            x_r, x_l = np.full(len(bound), r), np.full(len(bound), EVER)
            x_r[acts], x_l[acts] = np.array(self.counts)[end // n], ts[end % n]
            out.append(stepped(np.append(bound[:-1], EVER), x_r, x_l))
        return out

    def _state(self, r: np.ndarray, tick: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.counts, r) * len(self.ticks.ts) + tick

    def taken(self, r: int, last: int) -> tuple[list[int], list[int]]:
        """(ticks, replicas after each) of the actions from one entry state."""
        at, to, since = [], [], 0
        while True:
            i = int(self.first(r, np.array([last]), np.array([since]))[0])
            if i == len(self.ticks.ts):
                return at, to
            r = int(self.after[self.place[r]][i])
            last, since = int(self.ticks.ts[i]), i + 1
            at.append(i)
            to.append(r)


def stepped(hi: np.ndarray, x_r: np.ndarray, x_l: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring steps of one outcome become one."""
    last = np.append((x_r[1:] != x_r[:-1]) | (x_l[1:] != x_l[:-1]), True)
    return hi[last], x_r[last], x_l[last]


def through(maps: dict, r: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The states that (r, last) leave a chunk with."""
    out_r, out_l = r.copy(), last.copy()
    for k in np.unique(r):
        if int(k) not in maps:
            raise RuntimeError(f"a chunk has no map for {k} replicas")
        hi, x_r, x_l = maps[int(k)]
        at = r == k
        step = np.searchsorted(hi, last[at], "left")
        out_r[at], out_l[at] = x_r[step], np.where(x_l[step] == EVER, last[at], x_l[step])
    return out_r, out_l


def composed(first: tuple, r: int, then: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The map of entering with ``r`` replicas, continued by the next chunk's maps."""
    hi, x_r, x_l = first
    acted = x_l != EVER
    y_r, y_l = through(then, x_r[acted], x_l[acted])
    hi = hi[acted]
    if not acted.all():  # states handed on, all above the last bound: the next chunk's own steps
        t_hi, t_r, t_l = then[r]
        above = t_hi > (hi[-1] if len(hi) else NONE - 1)
        hi, y_r, y_l = (np.concatenate(x) for x in ((hi, t_hi[above]), (y_r, t_r[above]), (y_l, t_l[above])))
    return stepped(hi, y_r, y_l)


# ------------------------------------------------------------- the passes

def _maps_of(table: pa.Table) -> dict[int, dict[int, tuple]]:
    """chunk -> replicas -> step function, in the order of chunks."""
    out: dict[int, dict[int, tuple]] = {}
    rows = zip(*(table.column(c).to_pylist() for c in ("chunk", "e_r", "hi", "x_r", "x_l")))
    for chunk, r, *steps in sorted(rows, key=lambda x: x[:2]):
        out.setdefault(chunk, {})[r] = tuple(np.array(s, np.int64) for s in steps)
    return out


def _map_rows(namespace: str, chunk: int, maps: dict, init: int) -> pa.Table:
    n = len(maps)
    steps = list(zip(*maps.values()))
    return pa.table({"namespace": pa.array([namespace] * n), "chunk": pa.array([chunk] * n, pa.int64()), "e_r": pa.array(list(maps), pa.int64()),
                     **{c: pa.array([s.tolist() for s in x], pa.list_(pa.int64())) for c, x in zip(("hi", "x_r", "x_l"), steps)},
                     "init": pa.array([init] * n, pa.int64())})


def _chunk_maps(cfg: ScalerConfig, parity: bool, static: bool):
    def run(table: pa.Table) -> pa.Table:
        ticks, table = Ticks.of(table, cfg, parity, static)
        init, lo, hi = (table.column(c)[0].as_py() for c in ("init", "least", "most"))
        counts = [init] if static else sorted({init, *range(lo, hi + 1)})
        maps = dict(zip(counts, Actions(ticks, counts).map()))
        return _map_rows(table.column("namespace")[0].as_py(), table.column("chunk")[0].as_py(), maps, init)

    return run


def _compose(table: pa.Table) -> pa.Table:
    """One group's maps as one map under the group's number."""
    namespace, init, group = (table.column(c)[0].as_py() for c in ("namespace", "init", "group"))
    whole = None
    for maps in _maps_of(table).values():
        whole = maps if whole is None else {r: composed(steps, r, maps) for r, steps in whole.items()}
    return _map_rows(namespace, group, whole, init)


def _walk(table: pa.Table) -> pa.Table:
    """The entry state of every chunk of a group, from that of the group."""
    namespace = table.column("namespace")[0].as_py()
    r, last = (np.array([table.column(c)[0].as_py()]) for c in ("in_r", "in_l"))
    rows = []
    for chunk, maps in _maps_of(table).items():
        rows.append((namespace, chunk, int(r[0]), int(last[0])))
        r, last = through(maps, r, last)
    return pa.table(dict(zip(("namespace", "chunk", "in_r", "in_l"), (pa.array(c) for c in zip(*rows)))))


def _decisions(cfg: ScalerConfig, parity: bool, static: bool):
    def run(table: pa.Table) -> pa.Table:
        ticks, table = Ticks.of(table, cfg, parity, static)
        r, last, lo, hi = (table.column(c)[0].as_py() for c in ("in_r", "in_l", "least", "most"))
        counts = [r] if static else sorted({r, *range(lo, hi + 1)})
        at, to = Actions(ticks, counts).taken(r, last)
        n = len(ticks.ts)
        # the state that a tick finds is that after the last action before it
        found = np.searchsorted(np.array(at, np.int64), np.arange(n), "left")
        cur = ticks.replicas if static else np.array([r, *to], np.int64)[found]
        acted = np.array([last, *(int(t) for t in ticks.ts[at])], np.int64)[found]
        target, action, reason = ticks.decide(cur, (acted != NONE) & (ticks.ts - acted < ticks.cooldown(cur)))
        text = lambda names, code: pa.DictionaryArray.from_arrays(pa.array(code, pa.int32()), pa.array(names)).cast(pa.string())
        return pa.table({"namespace": table.column("namespace"), "id": table.column("id"), "ts": table.column("ts"), "current_replicas": pa.array(cur, pa.int64()),
                         "target_replicas": pa.array(target, pa.int64()), "action": text(ACTIONS, action), "reason": text(REASONS, reason)})

    return run


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def entry_states(maps: DataFrame, chunks: int, fan_in: int = FAN_IN) -> DataFrame:
    """(namespace, chunk, in_r, in_l) for every chunk, from the chunks' maps; ``chunks``: the most of any namespace."""
    levels = [maps]
    while chunks > fan_in:
        grouped = levels[-1].withColumn("group", F.floor(F.col("chunk") / F.lit(fan_in)).cast("long"))
        levels.append(_written(grouped.groupBy("namespace", "group").applyInArrow(_compose, _MAP_SCHEMA), "scaler-maps"))
        chunks = -(-chunks // fan_in)
    entry = None
    for level in reversed(levels):
        group = F.lit(0).cast("long") if entry is None else F.floor(F.col("chunk") / F.lit(fan_in)).cast("long")
        level = level.withColumn("group", group)
        if entry is None:  # a namespace starts with its replicas and no action
            level = level.withColumn("in_r", F.col("init")).withColumn("in_l", F.lit(NONE).cast("long"))
        else:
            level = level.join(entry.withColumnRenamed("chunk", "group"), ["namespace", "group"])
        entry = level.groupBy("namespace", "group").applyInArrow(_walk, _ENTRY_SCHEMA)
    return entry


def scaling_scan_chunked(inputs: DataFrame, cfg: ScalerConfig = ScalerConfig(), parity_noop: bool = False,
                         static_current: bool = False, target_rows: int = 100_000,
                         span_seconds: int = SPAN, fan_in: int = FAN_IN) -> DataFrame:
    """M11 / M13 decisions, identical to the sequential scan, with work split by time chunk.

    Chunks hold about ``target_rows`` ticks of a namespace (ticks of one and the same
    time stay together); a quiet namespace is one chunk and a hot one is spread over many
    tasks.  The inputs are evaluated once, into shared scratch.
    """
    spark = inputs.sparkSession
    ship_package(spark)
    span = span_seconds * 1_000_000
    ts_type = dict(inputs.dtypes)["ts"]
    src = inputs.select(*_IN_COLS).withColumn("ts_us", epoch_micros(F.col("ts"))) \
        .withColumn("_span", F.floor(F.col("ts_us") / F.lit(span)).cast("long"))
    for c in ("replicas", "min_replicas", "max_replicas"):
        src = src.withColumn(c, F.col(c).cast("long"))
    src = _written(src, "scaler-inputs")
    first = F.struct("ts_us", "id")
    spans = _written(src.groupBy("namespace", "_span").agg(
        F.count(F.lit(1)).alias("_n"), F.min("min_replicas").alias("least"), F.greatest(F.max("max_replicas"), F.max("min_replicas")).alias("most"),
        F.min(first).alias("first"), F.min_by("replicas", first).alias("init")), "scaler-spans")
    whole = spans.groupBy("namespace").agg(F.sum("_n").alias("_total"), F.max("_n").alias("_busiest"), F.min("least").alias("least"), F.max("most").alias("most"),
                                           F.min_by("init", "first").alias("init"))
    size = whole.agg(F.max("_total"), F.max("_busiest")).first()
    decide = _decisions(cfg, parity_noop, static_current)
    schema = (f"namespace string, id long, ts {ts_type}, current_replicas long, target_replicas long, "
              "action string, reason string")
    facts = whole.select("namespace", "least", "most", "init")
    if size[0] is None or size[0] <= target_rows:  # every namespace is one chunk
        ticks = src.join(facts, "namespace").withColumn("in_r", F.col("init")).withColumn("in_l", F.lit(NONE).cast("long"))
        return ticks.groupBy("namespace").applyInArrow(decide, schema)
    spans = spans.select("namespace", "_span", "_n").withColumn("_sub", F.lit(0).cast("long"))
    src = src.withColumn("_sub", F.lit(0).cast("long"))
    if size[1] > target_rows:  # busy spans are counted again in finer ones
        busy = spans.where(F.col("_n") > target_rows).select("namespace", "_span", F.greatest(
            F.floor(F.lit(float(span) * target_rows / 4) / F.col("_n")), F.lit(1)).cast("long").alias("_width"))
        src = src.join(busy, ["namespace", "_span"], "left").withColumn(
            "_sub", F.coalesce(F.floor(F.pmod("ts_us", F.lit(span)) / F.col("_width")).cast("long"), F.lit(0).cast("long"))).drop("_width")
        spans = src.groupBy("namespace", "_span", "_sub").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("namespace").orderBy("_span", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    number = F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / F.lit(target_rows))
    # numbers without gaps, though a sub-span may hold more ticks than a chunk
    spans = spans.withColumn("_number", number).withColumn("chunk", (F.dense_rank().over(Window.partitionBy("namespace").orderBy("_number")) - 1).cast("long"))
    spans = _written(spans.select("namespace", "_span", "_sub", "chunk").join(facts, "namespace"), "scaler-chunks")
    ticks = src.join(spans, ["namespace", "_span", "_sub"])
    maps = _written(ticks.groupBy("namespace", "chunk").applyInArrow(_chunk_maps(cfg, parity_noop, static_current), _MAP_SCHEMA), "scaler-maps")
    entry = entry_states(maps, spans.agg(F.max("chunk")).first()[0] + 1, fan_in)
    return ticks.join(entry, ["namespace", "chunk"]).groupBy("namespace", "chunk").applyInArrow(decide, schema)
