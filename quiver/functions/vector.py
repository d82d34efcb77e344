"""Vector similarity as JVM-side column expressions.

Scores are computed in double precision with a left-to-right sum over the
dimensions (``aggregate`` folds in order).  The numpy block scorer in
``quiver.operators.block`` uses the same order, so both paths produce the
same bits, and ranking on raw scores is deterministic across them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metric spellings accepted by the index, the server API and the
# model comments, normalised to the three index metrics.
METRIC_ALIASES = {
    "l2": "l2",
    "l2_norm": "l2",
    "cosine": "cosine",
    "dot": "dot",
    "dot_product": "dot",
}

DIMENSION_ERROR = "Vectors must have the same dimension"


def normalize_metric(metric: str) -> str:
    key = (metric or "").strip().lower()
    if key not in METRIC_ALIASES:
        raise ValueError(f"Unknown metric type: {metric}")
    return METRIC_ALIASES[key]


def ascending(metric: str) -> bool:
    """l2 is a distance (smaller is better); cosine and dot are similarities."""
    return normalize_metric(metric) == "l2"


def _col(v) -> Column:
    if isinstance(v, Column):
        return v
    if isinstance(v, str):
        return F.col(v)
    return vector_literal(v)


def vector_literal(values: Sequence[float]) -> Column:
    """A driver-side vector (bounded: one query) as an ARRAY<DOUBLE> literal."""
    return F.lit([float(x) for x in values]).cast("array<double>")


def _guarded(a: Column, b: Column, expr: Column) -> Column:
    return (
        F.when(a.isNull() | b.isNull(), F.lit(None).cast("double"))
        .when(F.size(a) == F.size(b), expr)
        .otherwise(F.raise_error(F.lit(DIMENSION_ERROR)).cast("double"))
    )


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def _dot_raw(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_distance(a, b) -> Column:
    """sqrt(sum((a_i - b_i)^2)); error on unequal length."""
    a, b = _col(a), _col(b)

    def sq(x, y):
        d = x.cast("double") - y.cast("double")
        return d * d

    return _guarded(a, b, F.sqrt(_sum(F.zip_with(a, b, sq))))


def dot_product(a, b) -> Column:
    a, b = _col(a), _col(b)
    return _guarded(a, b, _dot_raw(a, b))


def cosine_similarity(a, b) -> Column:
    """a.b / (|a| |b|); 0 when either norm is 0."""
    a, b = _col(a), _col(b)
    na, nb = _dot_raw(a, a), _dot_raw(b, b)
    expr = F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(_dot_raw(a, b) / (F.sqrt(na) * F.sqrt(nb)))
    return _guarded(a, b, expr)


_SCORERS = {"l2": l2_distance, "cosine": cosine_similarity, "dot": dot_product}


def metric_score(metric: str, a, b) -> Column:
    return _SCORERS[normalize_metric(metric)](a, b)


def order_columns(metric: str, score: str = "score", id_col: str = "vec_id") -> list[Column]:
    """Best first, ties to the lowest id."""
    s = F.col(score).asc() if ascending(metric) else F.col(score).desc()
    return [s, F.col(id_col).asc()]


def round_score(c: Column, places: int = 6) -> Column:
    return F.round(c, places)


def as_double_array(c) -> Column:
    return F.transform(_col(c), lambda x: x.cast("double"))
