"""Tenant, deployment, index-metadata and quota tables: T1-T16, S5.

Single-key lookups and saves of the reference are re-aimed as jobs over a
table of keys or of change rows, so each is one join / one window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Defaults of the control plane.
DEFAULT_QUOTA = {"max_indices": 100, "max_storage": "1Ti", "current_indices": 0, "current_storage": "0Gi"}
REQUEST_DEFAULTS = {"replicas": 1, "cpu": "500m", "memory": "1Gi", "disk": "10Gi", "dimension": 128,
                    "vector_count": 10000}
DETAIL_DEFAULTS = {"user_id": "unknown", "service_name": "unknown", "status": "unknown", "dimension": 128,
                   "vector_count": 10000, "replicas": 1}
BARE_INT = r"^[+-]?[0-9]+$"


def containers_by_org(containers: DataFrame, orgs: DataFrame | None = None, org_col: str = "tenant_org_id") -> DataFrame:
    """Live (not deleted) containers, optionally of the orgs in ``orgs``."""
    live = containers.where(~F.col("deleted"))
    if orgs is None:
        return live
    return live.join(orgs.select(org_col), org_col, "left_semi")


def key_lookup(keys: DataFrame, table: DataFrame, key_cols: list[str]) -> DataFrame:
    """Every requested key with its full row (deleted rows included) and ``found``."""
    t = table.withColumn("_found", F.lit(True))
    return keys.select(*key_cols).join(t, key_cols, "left") \
        .withColumn("found", F.coalesce(F.col("_found"), F.lit(False))).drop("_found")


def soft_delete(containers: DataFrame, requests: DataFrame, key_cols: list[str], ts_col: str = "requested_at") -> DataFrame:
    """Mark matching containers deleted; ``deleted_at`` = latest request time."""
    req = requests.groupBy(*key_cols).agg(F.max(ts_col).alias("_del_at"))
    base = containers if "deleted_at" in containers.columns else \
        containers.withColumn("deleted_at", F.lit(None).cast("timestamp_ntz"))
    j = base.join(req, key_cols, "left")
    hit = F.col("_del_at").isNotNull()
    return (j.withColumn("deleted", F.col("deleted") | hit)
             .withColumn("deleted_at", F.when(hit, F.col("_del_at")).otherwise(F.col("deleted_at")))
             .drop("_del_at"))


def upsert(current: DataFrame, changes: DataFrame, key_cols: list[str], order_cols: list[str]) -> DataFrame:
    """T4: insert-or-replace by key; the newest version (greatest ``order_cols``, NULL oldest) wins.

    A hash aggregate (``max_by``) rather than a window: partial aggregation
    collapses a hot key map-side instead of sorting all its versions in one task.
    """
    allrows = current.unionByName(changes, allowMissingColumns=True)
    return latest_per_key(allrows, key_cols, order_cols)


def cluster_listing(deployments: DataFrame, replicas: DataFrame) -> DataFrame:
    """Deployments as cluster rows; status ``ready/desired`` or ``unknown``."""
    r = replicas.select("namespace", F.concat_ws("/", F.col("ready").cast("string"), F.col("desired").cast("string")).alias("_st"))
    j = deployments.join(r, "namespace", "left")
    return j.select("namespace", "user_id", "service_name", F.coalesce("_st", F.lit("unknown")).alias("status"),
                    "replicas")


def cluster_details(requested: DataFrame, deployments: DataFrame) -> DataFrame:
    """One row per requested namespace; defaults when no deployment row exists."""
    d = deployments.withColumn("_found", F.lit(True))
    j = requested.select("namespace").join(d, "namespace", "left")
    found = F.coalesce(F.col("_found"), F.lit(False))
    return j.select(
        "namespace",
        F.coalesce("user_id", F.lit(DETAIL_DEFAULTS["user_id"])).alias("user_id"),
        F.coalesce("service_name", F.lit(DETAIL_DEFAULTS["service_name"])).alias("service_name"),
        F.coalesce("status", F.lit(DETAIL_DEFAULTS["status"])).alias("status"),
        F.coalesce("replicas", F.lit(DETAIL_DEFAULTS["replicas"])).cast("long").alias("replicas"),
        F.lit(DETAIL_DEFAULTS["dimension"]).cast("long").alias("dimension"),
        F.lit(DETAIL_DEFAULTS["vector_count"]).cast("long").alias("vector_count"),
        found.alias("found"),
    )


def index_list(index_metadata: DataFrame) -> DataFrame:
    """All index metadata; the listing view reports status ``active``."""
    return index_metadata.select("id", "index_name", "namespace", "metric", "document_count",
                                 F.lit("active").alias("listing_status"))


def delete_by_keys(table: DataFrame, keys: DataFrame, key_cols: list[str]) -> DataFrame:
    """Hard delete = anti-join with the delete keys."""
    return table.join(keys.select(*key_cols), key_cols, "left_anti")


def _quota_defaults(q: DataFrame) -> list:
    return [
        F.coalesce(q["max_indices"], F.lit(DEFAULT_QUOTA["max_indices"])).cast("long").alias("max_indices"),
        F.coalesce(q["max_storage"], F.lit(DEFAULT_QUOTA["max_storage"])).alias("max_storage"),
        F.coalesce(q["current_indices"], F.lit(DEFAULT_QUOTA["current_indices"])).cast("long").alias("current_indices"),
        F.coalesce(q["current_storage"], F.lit(DEFAULT_QUOTA["current_storage"])).alias("current_storage"),
    ]


def _with_storage(q: DataFrame) -> DataFrame:
    for c in ("max_storage", "current_storage"):
        if c not in q.columns:
            q = q.withColumn(c, F.lit(None).cast("string"))
    return q


def quota_check(tenants: DataFrame, quotas: DataFrame) -> DataFrame:
    """``allowed = current < max``; a missing quota gets the default row and is allowed."""
    q = _with_storage(quotas).withColumn("has_quota_row", F.lit(True))
    j = tenants.select("tenant_id").distinct().join(q, "tenant_id", "left")
    cols = _quota_defaults(j)
    out = j.select("tenant_id", *cols, F.coalesce("has_quota_row", F.lit(False)).alias("has_quota_row"))
    return out.withColumn("allowed", F.col("current_indices") < F.col("max_indices"))


def quota_usage_apply(quotas: DataFrame, events: DataFrame, inc_col: str = "increase") -> DataFrame:
    """+1 / -1 per create / delete event; missing quota starts from the default row.

    One aggregation over the event table (partial sums map-side), then one
    join; usage may go below zero as in the reference.
    """
    delta = events.groupBy("tenant_id").agg(
        F.sum(F.when(F.col(inc_col), 1).otherwise(-1)).cast("long").alias("delta"),
        F.count(F.lit(1)).alias("events"))
    q = _with_storage(quotas)
    j = q.join(delta, "tenant_id", "full_outer")
    cols = _quota_defaults(j)
    out = j.select("tenant_id", *cols, F.coalesce("delta", F.lit(0)).alias("delta"))
    return out.withColumn("current_indices", F.col("current_indices") + F.col("delta")).drop("delta")


def request_normalise(requests: DataFrame) -> DataFrame:
    """Required-field check, namespace default, resource defaults, ``Gi`` for bare numbers."""
    def blank(c):
        return F.col(c).isNull() | (F.col(c) == "")

    reject = (F.when(blank("tenant_org_id"), F.lit("tenant_org_id is required for multi-tenancy"))
              .when(blank("user_id"), F.lit("user is required"))
              .when(blank("service_name"), F.lit("service_name is required")))
    ns = F.when(blank("namespace"), F.concat_ws("-", "tenant_org_id", "user_id", "service_name")).otherwise(F.col("namespace"))

    def gi(c, default):
        v = F.when(blank(c), F.lit(default)).otherwise(F.col(c))
        return F.when(v.rlike(BARE_INT), F.concat(v, F.lit("Gi"))).otherwise(v)

    vc = F.col("vector_count") if "vector_count" in requests.columns else F.lit(None).cast("long")
    return requests.select(
        "id", "tenant_org_id", "user_id", "service_name",
        ns.alias("namespace"),
        F.when(F.coalesce(F.col("replicas"), F.lit(0)) <= 0, F.lit(REQUEST_DEFAULTS["replicas"])).otherwise(F.col("replicas")).cast("long").alias("replicas"),
        F.when(blank("cpu"), F.lit(REQUEST_DEFAULTS["cpu"])).otherwise(F.col("cpu")).alias("cpu"),
        gi("memory", REQUEST_DEFAULTS["memory"]).alias("memory"),
        gi("disk", REQUEST_DEFAULTS["disk"]).alias("disk"),
        F.when(F.coalesce(F.col("dimension"), F.lit(0)) <= 0, F.lit(REQUEST_DEFAULTS["dimension"])).otherwise(F.col("dimension")).cast("long").alias("dimension"),
        F.when(F.coalesce(vc, F.lit(0)) <= 0, F.lit(REQUEST_DEFAULTS["vector_count"])).otherwise(vc).cast("long").alias("vector_count"),
        reject.alias("reject_reason"),
    )


def container_metrics_project(wide: DataFrame) -> DataFrame:
    """Wide container metrics -> the narrow monitoring row."""
    return wide.select("id", "namespace", "cpu_usage", "memory_usage", "disk_usage", "qps", F.col("ts").alias("timestamp"))


def latest_per_key(df: DataFrame, key_cols: list[str], order_cols: list[str]) -> DataFrame:
    """Newest row per key via ``max_by`` of a struct: a hash aggregate with
    partial aggregation, so a hot key is reduced map-side, never sorted whole."""
    others = [c for c in df.columns if c not in key_cols]
    packed = F.struct(*[F.col(c) for c in others])
    order = F.struct(*[F.col(c) for c in order_cols])
    agg = df.groupBy(*key_cols).agg(F.max_by(packed, order).alias("_row"))
    return agg.select(*key_cols, *[F.col(f"_row.{c}").alias(c) for c in others])


def qps_view(metrics: DataFrame, latency: DataFrame) -> DataFrame:
    """Latest metric row per namespace joined with the namespace's latency stats."""
    latest = latest_per_key(metrics.select("namespace", "id", "qps", F.col("ts").alias("timestamp")),
                            ["namespace"], ["timestamp", "id"])
    return latest.join(latency, "namespace", "left")


def document_upsert(docs: DataFrame, changes: DataFrame, id_col: str = "doc_id", order_col: str = "version") -> DataFrame:
    """Put documents under a given or generated id; latest version per id wins."""
    # A generated id is a content hash, not a random uuid: a retried task
    # (lost executor) must produce the same id again.
    content = F.to_json(F.struct(*[F.col(c) for c in changes.columns if c != id_col]))
    auto = F.concat(F.lit("auto-"), F.substring(F.sha2(content, 256), 1, 20))
    ch = changes.withColumn(id_col, F.coalesce(F.col(id_col).cast("string"), auto))
    base = docs.withColumn(id_col, F.col(id_col).cast("string"))
    return upsert(base, ch, [id_col], [order_col])
