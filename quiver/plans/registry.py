"""Registry of named jobs and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

JOBS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
TAGS: dict[str, str] = {}


def normalize(df: DataFrame) -> DataFrame:
    """Integers as BIGINT, floats as DOUBLE: one type per kind for the result contract."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.FloatType):
            c = c.cast("double")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def job(name: str, oracle: str | None = None, tag: str = ""):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from quiver.session import checkpoint_dir, ship_package

            checkpoint_dir(spark)
            ship_package(spark)
            return normalize(fn(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        if name in JOBS:
            raise KeyError(f"duplicate job {name}")
        JOBS[name] = run
        if oracle is not None:
            ORACLE[name] = oracle
        TAGS[name] = tag
        return fn

    return deco
