"""Text-column normalisation as bulk column expressions.

Always ``try_cast``-style parsing: ANSI mode is on, and a bad value must
become the documented default, not a failed job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Leading-number patterns (what a "%f" / "%d" scan accepts).
FLOAT_PREFIX = r"^\s*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)"
INT_PREFIX = r"^\s*([+-]?[0-9]+)"
# Binary memory units in MiB.
MEMORY_UNITS_MIB = {"Ki": 1.0 / 1024, "Mi": 1.0, "Gi": 1024.0, "Ti": 1024.0 * 1024, "Pi": 1024.0 ** 3}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def leading_float(c) -> Column:
    """Leading decimal number of a string, NULL if none."""
    return F.regexp_extract(_c(c), FLOAT_PREFIX, 1).try_cast("double")


def leading_int(c) -> Column:
    return F.regexp_extract(_c(c), INT_PREFIX, 1).try_cast("long")


def parse_cpu(c, strict: bool = False) -> Column:
    """Strip ``m`` and divide by 1000 (so ``"2"`` -> 0.002 as in the reference).

    ``strict=True`` treats a bare number as whole cores.  Unparsable -> 0.
    """
    s = _c(c)
    milli = F.regexp_replace(s, "m$", "")
    v = F.coalesce(leading_float(milli), F.lit(0.0))
    if strict:
        return F.when(s.endswith("m"), v / 1000.0).otherwise(v)
    return v / 1000.0


def parse_memory_mib(c, parity: bool = False) -> Column:
    """Memory text in MiB.

    ``parity=True``: strip ``Mi`` and take the leading number (``"1Gi"`` -> 1).
    Default: honour the binary unit suffix (Ki, Mi, Gi, Ti, Pi).
    """
    s = _c(c)
    if parity:
        return F.coalesce(leading_float(F.regexp_replace(s, "Mi$", "")), F.lit(0.0))
    unit = F.regexp_extract(s, r"([KMGTP]i)$", 1)
    factor = F.lit(1.0)
    for u, f in MEMORY_UNITS_MIB.items():
        factor = F.when(unit == u, F.lit(f)).otherwise(factor)
    return F.coalesce(leading_float(s) * factor, F.lit(0.0))


def parse_percent(c) -> Column:
    """``"75%"`` -> 75.0; unparsable -> 0."""
    return F.coalesce(leading_float(F.regexp_replace(_c(c), "%$", "")), F.lit(0.0))


def parse_doc_count(c) -> Column:
    """U4: leading integer; empty or unparsable -> 0."""
    return F.coalesce(leading_int(_c(c)), F.lit(0)).cast("long")


def epoch_ms_to_rfc3339(c) -> Column:
    """Epoch milliseconds -> ``yyyy-MM-ddTHH:mm:ssZ`` in UTC, whole seconds.

    Built on TIMESTAMP_NTZ so the session time zone cannot shift it.
    """
    secs = F.floor(_c(c).cast("long") / 1000).cast("long")
    base = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    ts = F.timestamp_add("SECOND", secs, base)
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
