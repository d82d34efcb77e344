"""Log dataflow as DataFrame jobs: L1-L9.

Batch forms here; ``quiver.streaming.logs`` runs the same transforms on a
file stream.  Multi-line grouping needs "the latest first line at or before
this line", which is computed per bounded bucket of line numbers plus a small
per-bucket carry table, so no task ever holds a whole file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns and time formats of the log pipeline.
FIRSTLINE = r"^\d{4}-\d{2}-\d{2}"
ES_LINE = r"(?s)^(\d{4}-\d{2}-\d{2}[ ]\d{2}:\d{2}:\d{2}\.\d{3})[ ][A-Z][ ](.*)"
ES_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss.SSS"
KUBE_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{9}Z$"
#: The namespace that kube-tagged records are kept from, unless another is named.
ALLOWED_NAMESPACE = "search-system"
SEVERITY = "(?i)(Warning|Error|Fail)"
JOURNAL_UNITS = ("kubelet.service", "kernel.service")
DEFAULT_BUCKET_LINES = 1 << 20

KUBE_SCHEMA = T.StructType([
    T.StructField("log", T.StringType()),
    T.StructField("time", T.StringType()),
    T.StructField("kubernetes", T.StructType([
        T.StructField("namespace_name", T.StringType()), T.StructField("pod_name", T.StringType()),
        T.StructField("container_name", T.StringType())])),
])


def json_source(lines: DataFrame, raw_col: str = "raw") -> DataFrame:
    """L1: parse JSON lines; lines that are not a JSON object are kept, with ``unmatched`` set."""
    raw = F.col(raw_col)
    ok = F.try_parse_json(raw).isNotNull() & F.ltrim(raw).startswith("{")
    parsed = F.from_json(raw, KUBE_SCHEMA)
    return lines.select(
        "*",
        F.when(ok, parsed["log"]).alias("log"),
        F.when(ok & parsed["time"].rlike(KUBE_TIME), F.to_timestamp_ntz(
            F.regexp_replace(parsed["time"], "Z$", ""), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSSSSS"))).alias("time"),
        F.when(ok, parsed["kubernetes"]).alias("kubernetes"),
        F.when(~ok, raw).alias("unmatched"),
    )


def multiline_records(lines: DataFrame, line_col: str = "line_no", raw_col: str = "raw",
                      bucket_lines: int = DEFAULT_BUCKET_LINES, file_cols: list[str] | None = None) -> DataFrame:
    """L2: a record starts at a line beginning with a date; continuation lines join it.

    Returns ``(*file_cols, record_start, lines, text)``; lines before the
    first first-line of a file form a record of their own (start = their
    first line number, no time).
    """
    fc = list(file_cols or [])
    b = F.floor(F.col("_ln") / bucket_lines)
    df = lines.select(*fc, F.col(line_col).alias("_ln"), F.col(raw_col).alias("_raw")).withColumn("_b", b) \
        .withColumn("_first", F.col("_raw").rlike(FIRSTLINE))
    # latest first line inside the same bucket (window over a bounded bucket)
    wb = Window.partitionBy(*fc, "_b").orderBy("_ln").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_start_in", F.max(F.when(F.col("_first"), F.col("_ln"))).over(wb))
    # carry, one row per bucket: the latest first line of all earlier buckets, and the file's
    # first line, which starts the record of lines that no first line precedes
    per_b = df.groupBy(*fc, "_b").agg(F.max(F.when(F.col("_first"), F.col("_ln"))).alias("_mx"),
                                      F.min("_ln").alias("_bmin"))
    wc = Window.partitionBy(*fc).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_b.select(*fc, "_b", F.max("_mx").over(wc).alias("_carry"), F.min("_bmin").over(Window.partitionBy(*fc)).alias("_head"))
    df = df.join(carry, [*fc, "_b"], "left")
    allr = df.withColumn("_rec", F.coalesce("_start_in", "_carry", "_head"))
    g = allr.groupBy(*fc, "_rec").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sort_array(F.collect_list(F.struct("_ln", "_raw"))).alias("_parts"))
    out = g.select(*fc, F.col("_rec").alias("record_start"), "lines",
                   F.array_join(F.transform("_parts", lambda p: p["_raw"]), "\n").alias("text"))
    return out


def regex_fields(records: DataFrame, text_col: str = "text") -> DataFrame:
    """L3: named fields ``time`` and ``message`` of a search-node log record; time parsed."""
    t = F.regexp_extract(F.col(text_col), ES_LINE, 1)
    m = F.regexp_extract(F.col(text_col), ES_LINE, 2)
    matched = F.col(text_col).rlike(ES_LINE)
    return records.select("*", F.when(matched, F.to_timestamp_ntz(t, F.lit(ES_TIME_FORMAT))).alias("time"),
                          F.when(matched, m).alias("message"))


def namespace_filter(records: DataFrame, tag_col: str = "tag", allowed: str = ALLOWED_NAMESPACE) -> DataFrame:
    """L4: kube-tagged records must come from the ``allowed`` namespace; others pass."""
    kube = F.col(tag_col).startswith("kubernetes")
    ns = F.col("kubernetes.namespace_name")
    return records.where(~kube | F.coalesce(ns == F.lit(allowed), F.lit(False)))


def journal_source(records: DataFrame, unit_col: str = "unit") -> DataFrame:
    """The system journal's records of the two followed units, tagged ``kubelet`` or ``kernel``; other units are not read."""
    return records.where(F.col(unit_col).isin(*JOURNAL_UNITS)).withColumn("tag", F.substring_index(unit_col, ".", 1))


def severity_filter(records: DataFrame, message_col: str = "MESSAGE") -> DataFrame:
    """System records mentioning Warning, Error or Fail (any case)."""
    return records.where(F.coalesce(F.col(message_col).rlike(SEVERITY), F.lit(False)))


def enrich(records: DataFrame, hostname: str, node_name: str) -> DataFrame:
    """Host and node on every record; namespace, pod and container lifted from kube metadata."""
    out = records.withColumn("hostname", F.lit(hostname)).withColumn("node_name", F.lit(node_name))
    if "kubernetes" in records.columns:
        out = out.withColumn("kubernetes_ns", F.col("kubernetes.namespace_name")) \
            .withColumn("kubernetes_pod", F.col("kubernetes.pod_name")) \
            .withColumn("kubernetes_container", F.col("kubernetes.container_name"))
    return out


def metadata_join(records: DataFrame, pods: DataFrame, pod_col: str = "kubernetes_pod",
                  namespace_col: str = "kubernetes_ns") -> DataFrame:
    """Attach pod metadata (a dimension table; Spark broadcasts it when its size allows).

    Pods are named by namespace and name where ``pods`` has a ``namespace_name``
    column (two namespaces may use one pod name), else by name alone."""
    match = records[pod_col] == pods["pod_name"]
    if "namespace_name" in pods.columns:
        match = match & (records[namespace_col] == pods["namespace_name"])
        return records.join(pods, match, "left").drop(pods["pod_name"], pods["namespace_name"])
    return records.join(pods, match, "left").drop(pods["pod_name"])


def route(streams: dict[str, DataFrame]) -> DataFrame:
    """Every tagged stream into one common record schema, with its route."""
    out = None
    for tag, df in streams.items():
        d = df.withColumn("route", F.lit(tag))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def fanout_write(records: DataFrame, es_path: str, file_path: str, prefix: str, batch: str = "0") -> None:
    """Copy to two sinks: day-split under a prefix (index per day), and one file sink.

    Both sinks hold a folder per ``batch``, which a retry of that batch overwrites, so
    no record is doubled; the second sink is filled from the first, so the
    records are computed once."""
    day = F.coalesce(F.date_format("time", "yyyy.MM.dd"), F.lit("unknown"))
    keep = records.withColumn("logstash_prefix", F.lit(prefix)).withColumn("day", day)
    first = f"{es_path}/batch={batch}"
    keep.write.mode("overwrite").partitionBy("logstash_prefix", "day").parquet(first)
    stored = records.sparkSession.read.schema(keep.schema).parquet(first)
    stored.drop("logstash_prefix", "day").write.mode("overwrite").json(f"{file_path}/batch={batch}")
