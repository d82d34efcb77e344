"""Per-key ordered windows that do not put a hot key into one task.

Spark evaluates ``Window.partitionBy(key)`` by shuffling each key to one task;
a key holding a third of the rows would then be sorted by one task.  These
helpers partition by (key, time bucket) instead and bring in exactly the rows of
earlier buckets that a bounded frame can reach, so results are identical to the
plain window while every task holds at most one bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BUCKET_SECONDS = None     # None: per-key width from the key's row rate
TARGET_BUCKET_ROWS = 200_000
MIN_BUCKET_SECONDS = 60
MAX_BUCKET_SECONDS = 30 * 86400


def epoch_micros(ts: Column) -> Column:
    """Microseconds since the epoch of a TIMESTAMP_NTZ (no time-zone shift)."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def time_bucket(ts: Column, seconds: int) -> Column:
    return F.floor(epoch_micros(ts) / F.lit(seconds * 1_000_000)).cast("long")


def with_bucket_width(df: DataFrame, key_cols: list[str], ts_col: str, seconds: int | None,
                      min_seconds: int = MIN_BUCKET_SECONDS) -> DataFrame:
    """Adds ``_bw`` (bucket width in microseconds).  Fixed when ``seconds`` is given; else per
    key, so that a bucket holds about TARGET_BUCKET_ROWS rows at the key's average rate
    (one aggregation to a row per key, joined back; AQE splits a hot key in the join)."""
    if seconds:
        return df.withColumn("_bw", F.lit(int(max(seconds, min_seconds)) * 1_000_000).cast("long"))
    us = epoch_micros(F.col(ts_col))
    st = df.groupBy(*key_cols).agg(F.count(F.lit(1)).alias("_cnt"), (F.max(us) - F.min(us)).alias("_span"))
    width = F.greatest(F.col("_span"), F.lit(1)) * F.lit(float(TARGET_BUCKET_ROWS)) / F.col("_cnt")
    width = F.least(F.greatest(width, F.lit(float(max(min_seconds, MIN_BUCKET_SECONDS)) * 1e6)),
                    F.lit(float(max(MAX_BUCKET_SECONDS, min_seconds)) * 1e6))
    st = st.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key_cols)], F.floor(width).cast("long").alias("_bw"))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(key_cols)]
    return df.join(st, same, "left").select(*df.columns, "_bw")


def rows_history(df: DataFrame, key_cols: list[str], order_cols: list[str], n: int, columns, ts_col: str = "ts",
                 bucket_seconds: int | None = DEFAULT_BUCKET_SECONDS) -> DataFrame:
    """``df`` with columns over the frame of a row and the n-1 rows before it, of its key, in order.

    ``columns`` takes the window and returns a dict of names to expressions.  The rows are
    exchanged once, by (key, time bucket).  From the n-th row of a bucket on, a frame lies in its
    bucket.  The rows before need a carry: the first and last n-1 rows of all buckets, a
    table of at most 2(n-1) rows a bucket, read from the same exchange, hold their whole frames
    in order, so the same window over the key gives their columns.
    """
    h = n - 1
    base = with_bucket_width(df, key_cols, ts_col, bucket_seconds)
    base = base.withColumn("_b", F.floor(epoch_micros(F.col(ts_col)) / F.col("_bw")).cast("long")).drop("_bw")
    bucket = Window.partitionBy(*key_cols, "_b")
    placed = base.withColumn("_r", F.row_number().over(bucket.orderBy(*order_cols))).withColumn("_n", F.count(F.lit(1)).over(bucket))
    frame = lambda w: w.orderBy(*order_cols).rowsBetween(-h, 0)
    within = placed.withColumns(columns(frame(bucket))).where(F.col("_r") > h)
    if h <= 0:
        return within.drop("_b", "_r", "_n")
    edges = placed.where((F.col("_r") <= h) | (F.col("_r") > F.col("_n") - h))
    carried = edges.withColumns(columns(frame(Window.partitionBy(*key_cols)))).where(F.col("_r") <= h)
    return within.unionByName(carried).drop("_b", "_r", "_n")


def range_history(df: DataFrame, key_cols: list[str], ts_col: str, seconds: int,
                  bucket_seconds: int | None = DEFAULT_BUCKET_SECONDS) -> DataFrame:
    """Rows of ``df`` plus halo rows for a time frame reaching ``seconds`` back (inclusive).

    Partition windows by (key, ``_b``) and keep ``_own`` rows.  Buckets are at
    least ``seconds`` wide, so a row reaches at most one later bucket.
    """
    if bucket_seconds is not None and bucket_seconds < seconds:
        raise ValueError("bucket_seconds must be >= the frame length")
    us = epoch_micros(F.col(ts_col))
    base = with_bucket_width(df, key_cols, ts_col, bucket_seconds, min_seconds=seconds)
    base = base.withColumn("_b", F.floor(us / F.col("_bw")).cast("long"))
    own = base.withColumn("_own", F.lit(True))
    next_start = (F.col("_b") + 1) * F.col("_bw")
    halo = base.where(us >= next_start - F.lit(seconds * 1_000_000)) \
        .withColumn("_b", F.col("_b") + 1).withColumn("_own", F.lit(False))
    return own.unionByName(halo).drop("_bw")


def descending_position(df: DataFrame, key_cols: list[str], ts_col: str, id_col: str,
                        bucket_seconds: int | None = DEFAULT_BUCKET_SECONDS, name: str = "position") -> DataFrame:
    """``row_number() over (partition by key order by ts desc, id desc)`` computed per time bucket:
    bucket-local rank plus the number of rows in the key's later buckets."""
    b = with_bucket_width(df, key_cols, ts_col, bucket_seconds)
    b = b.withColumn("_b", F.floor(epoch_micros(F.col(ts_col)) / F.col("_bw")).cast("long")).drop("_bw")
    local = F.row_number().over(Window.partitionBy(*key_cols, "_b").orderBy(F.col(ts_col).desc(), F.col(id_col).desc()))
    counts = b.groupBy(*key_cols, "_b").agg(F.count(F.lit(1)).alias("_n"))
    later = Window.partitionBy(*key_cols).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(later), F.lit(0))).drop("_n")
    return b.withColumn("_local", local).join(offsets, [*key_cols, "_b"]) \
        .withColumn(name, (F.col("_local") + F.col("_off")).cast("int")).drop("_b", "_local", "_off")
