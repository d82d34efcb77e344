"""File sources and sinks: JSON directory scan (S6), metric append (S7), resources JSON."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Microsecond timestamps survive a JSON round trip (the writer's default keeps milliseconds).
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
RESOURCES_SCHEMA = T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType()))


def json_dir_scan(spark: SparkSession, path: str, prefix: str, schema: T.StructType,
                  multi_line: bool = False) -> DataFrame:
    """Every ``<prefix>_*.json`` file under ``path``; unreadable files and malformed records skipped."""
    return (spark.read.schema(schema)
            .option("pathGlobFilter", f"{prefix}_*.json")
            .option("multiLine", str(multi_line).lower())
            .option("mode", "DROPMALFORMED")
            .option("ignoreCorruptFiles", "true")
            .option("timestampNTZFormat", TS_FORMAT)
            .json(path))


def write_named_json(spark: SparkSession, df: DataFrame, path: str, prefix: str) -> list[str]:
    """Write ``df`` as JSON lines and name the part files ``<prefix>_<n>.json`` (driver renames a
    bounded list of part files; the rows never leave the executors).

    Every call uses fresh names and its own staging folder, so earlier files stay;
    a rename that fails is an error, and then the staging folder is kept."""
    call = uuid.uuid4().hex
    tmp = path.rstrip("/") + f"/_staging_{prefix}_{call}"
    df.write.mode("errorifexists").option("timestampNTZFormat", TS_FORMAT).json(tmp)
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    src = jvm.org.apache.hadoop.fs.Path(tmp)
    fs = src.getFileSystem(conf)
    out = []
    parts = sorted(st.getPath().toString() for st in fs.listStatus(src) if st.getPath().getName().startswith("part-"))
    for i, p in enumerate(parts):
        dst = f"{path.rstrip('/')}/{prefix}_{call}_{i:05d}.json"
        if not fs.rename(jvm.org.apache.hadoop.fs.Path(p), jvm.org.apache.hadoop.fs.Path(dst)):
            raise OSError(f"could not rename {p} to {dst}")
        out.append(dst)
    fs.delete(src, True)
    return out


def write_text_file(spark: SparkSession, path: str, text: str) -> None:
    """A small control file (e.g. a deliberately corrupt one in tests) through the Hadoop FS API."""
    jvm = spark.sparkContext._jvm
    jp = jvm.org.apache.hadoop.fs.Path(path)
    fs = jp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(jp, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def metrics_append(df: DataFrame, path: str, partition_cols: list[str] | None = None) -> None:
    """Append metric samples to a Parquet table."""
    w = df.write.mode("append")
    if partition_cols:
        w = w.partitionBy(*partition_cols)
    w.parquet(path)


def container_json_parse(df: DataFrame, col: str = "resources") -> DataFrame:
    """Resources JSON -> limits / requests columns; a missing key gives ''."""
    m = F.from_json(F.col(col), RESOURCES_SCHEMA)

    def get(outer, inner):
        return F.coalesce(m.getItem(outer).getItem(inner), F.lit(""))

    return df.select("*", get("limits", "cpu").alias("limits_cpu"), get("limits", "memory").alias("limits_memory"),
                     get("requests", "cpu").alias("requests_cpu"), get("requests", "memory").alias("requests_memory"))
