"""Vector tables: declared schema and parameters (S1), validation (S2), packed form (S3)."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiver.functions.vector import normalize_metric

# Mapping defaults of a vector field and the document field types.
DEFAULT_METRIC = "l2"
DEFAULT_NLIST = 100
DEFAULT_NPROBE = 10
FIELD_TYPES = {
    "text": T.StringType(), "keyword": T.StringType(), "integer": T.IntegerType(), "long": T.LongType(),
    "float": T.FloatType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "date": T.TimestampType(),
    "dense_vector": T.ArrayType(T.FloatType()),
}


@dataclass(frozen=True)
class VectorField:
    """A declared vector field (dimension required, positive)."""
    name: str
    dimension: int
    metric: str = DEFAULT_METRIC
    nlist: int = DEFAULT_NLIST
    nprobe: int = DEFAULT_NPROBE
    field_mapping: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.dimension is None or self.dimension <= 0:
            raise ValueError("[dimension] must be a positive integer")
        object.__setattr__(self, "metric", normalize_metric(self.metric))

    def schema(self, id_col: str = "doc_id", id_type: T.DataType = T.LongType()) -> T.StructType:
        fields = [T.StructField(id_col, id_type), T.StructField(self.name, T.ArrayType(T.FloatType()))]
        for k, v in self.field_mapping.items():
            if v not in FIELD_TYPES:
                raise ValueError(f"unsupported field type {v!r} for {k!r}")
            fields.append(T.StructField(k, FIELD_TYPES[v]))
        return T.StructType(fields)


def vector_source(spark: SparkSession, path: str, vf: VectorField, id_col: str = "doc_id",
                  fmt: str = "parquet") -> DataFrame:
    """Read a vector table with the declared schema (no inference, pruned to declared columns)."""
    want = vf.schema(id_col)
    df = spark.read.format(fmt).load(path)
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in want.fields])


def invalid_reason(vec: Column, dimension: int) -> Column:
    """Why a vector cannot be indexed, or NULL."""
    bad_value = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return (F.when(vec.isNull(), F.lit("null vector"))
            .when(F.size(vec) != dimension, F.concat(F.lit(f"dimension mismatch: expected {dimension}, got "),
                                                     F.size(vec).cast("string")))
            .when(bad_value, F.lit("non-finite value")))


def vector_validate(df: DataFrame, vec_col: str, dimension: int) -> tuple[DataFrame, DataFrame]:
    """Split into (valid rows, quarantine rows with a ``reason``); one pass, no rows lost."""
    tagged = df.withColumn("reason", invalid_reason(F.col(vec_col), dimension))
    return tagged.where(F.col("reason").isNull()).drop("reason"), tagged.where(F.col("reason").isNotNull())


@F.pandas_udf(T.BinaryType())
def vector_pack(v: pd.Series) -> pd.Series:
    """S3: ARRAY<FLOAT> -> big-endian float32 bytes (Arrow batches, numpy per batch)."""
    return v.map(lambda a: None if a is None else np.asarray(a, dtype=">f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def vector_unpack(b: pd.Series) -> pd.Series:
    """S3: big-endian float32 bytes -> ARRAY<FLOAT>."""
    return b.map(lambda x: None if x is None else np.frombuffer(x, dtype=">f4").astype(np.float32))
