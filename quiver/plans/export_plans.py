"""Tenant-scoped export, restore and verification of the tenant tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quiver.operators import export as B
from quiver.plans.registry import job
from quiver.session import scratch_path
from quiver.sources.fixtures import spark_view, with_views

TENANT = "org-3"
_EV = ["fx_tenant_containers", "fx_deployments", "fx_index_metadata", "fx_tenant_quota"]


# the tenant's index metadata: namespaces are those of the deployments with the same ids
_META = ("meta", "SELECT m.id, m.index_name, coalesce(d.namespace, m.namespace) AS namespace, m.metric, m.status, m.document_count "
                 "FROM fx_index_metadata m LEFT JOIN fx_deployments d ON d.id = m.id")


def tenant_tables(spark, sf_dir):
    deployments = spark_view(spark, sf_dir, "fx_deployments")
    meta = spark_view(spark, sf_dir, "fx_index_metadata").alias("m").join(deployments.alias("d"), F.col("m.id") == F.col("d.id"), "left").select(
        "m.id", "m.index_name", F.coalesce("d.namespace", "m.namespace").alias("namespace"), "m.metric", "m.status", "m.document_count")
    return {
        "tenant_containers": spark_view(spark, sf_dir, "fx_tenant_containers"),
        "deployment_status": deployments,
        "index_metadata": meta,
        "tenant_quota": spark_view(spark, sf_dir, "fx_tenant_quota"),
    }


# every row of a table as text: its columns by name, joined
_ROWS = {"tenant_containers": ("fx_tenant_containers", ["cpu", "deleted", "dimension", "id", "memory", "namespace", "replicas", "service_name", "tenant_org_id", "user_id"]),
         "deployment_status": ("fx_deployments", ["id", "namespace", "replicas", "service_name", "status", "tenant_org_id", "user_id"]),
         "index_metadata": ("meta", ["document_count", "id", "index_name", "metric", "namespace", "status"]),
         "tenant_quota": ("fx_tenant_quota", ["current_indices", "max_indices", "tenant_id"])}
_OWN = f"tenant_org_id = '{TENANT}'"
_OWNED = f"SELECT {{}} FROM fx_tenant_containers WHERE {_OWN} UNION SELECT {{}} FROM fx_deployments WHERE {_OWN}"
_OF_TENANT = {"tenant_containers": _OWN, "deployment_status": _OWN, "index_metadata": f"namespace IN ({_OWNED.format('namespace', 'namespace')})",
              "tenant_quota": f"tenant_id IN ({_OWNED.format('user_id', 'user_id')})"}


def _content_sql(where):
    return " UNION ALL ".join(f"SELECT '{t}' AS table_name, concat_ws('|', {', '.join(f'CAST({c} AS VARCHAR)' for c in cols)}) AS content FROM {view} WHERE {where[t]}"
                              for t, (view, cols) in _ROWS.items())


_TENANT_CONTENT = _content_sql(_OF_TENANT)


def contents(tables):
    """Every row of restored tables as text."""
    out = None
    for name, df in tables.items():
        c = df.select(F.lit(name).alias("table_name"), F.concat_ws("|", *[F.col(x).cast("string") for x in sorted(df.columns)]).alias("content"))
        out = c if out is None else out.unionByName(c)
    return out


@job("B1_tenant_export", with_views(_TENANT_CONTENT, _EV, [_META]), "export")
def b1(spark, sf_dir):
    root = scratch_path(spark, "backups")
    B.export_snapshot(spark, tenant_tables(spark, sf_dir), TENANT, root, "snap-1")
    return contents(B.restore_snapshot(spark, root, TENANT, "snap-1"))


@job("B2_full_export", with_views(_content_sql({t: "true" for t in _ROWS}), _EV, [_META]), "export")
def b2(spark, sf_dir):
    root = scratch_path(spark, "backups")
    B.export_snapshot(spark, tenant_tables(spark, sf_dir), B.ALL_TENANTS, root, "snap-all")
    return contents(B.restore_snapshot(spark, root, B.ALL_TENANTS, "snap-all"))


def _later(tables):
    """The tables some time on: containers of every seventh id have one more replica, the others are as they were."""
    t = tables["tenant_containers"]
    return tables | {"tenant_containers": t.withColumn("replicas", F.when(F.col("id") % 7 == 0, F.col("replicas") + 1).otherwise(F.col("replicas")).cast("int"))}


_LATER_VIEW = ("later", "SELECT * REPLACE (CASE WHEN id % 7 = 0 THEN replicas + 1 ELSE replicas END AS replicas) FROM fx_tenant_containers")


@job("B4_snapshot_restore", with_views(_TENANT_CONTENT.replace("FROM fx_tenant_containers WHERE tenant_org_id", "FROM later WHERE tenant_org_id", 1), _EV, [_META, _LATER_VIEW]), "export")
def b4(spark, sf_dir):
    """Two snapshots of a tenant; the second, which holds only what changed, is restored."""
    root = scratch_path(spark, "backups")
    tables = tenant_tables(spark, sf_dir)
    B.export_snapshot(spark, tables, TENANT, root, "snap-a")
    B.export_snapshot(spark, _later(tables), TENANT, root, "snap-b")
    names = [r["snapshot"] for r in B.list_snapshots(spark, root, TENANT).collect()]
    if names != ["snap-a", "snap-b"]:
        raise RuntimeError(f"unexpected snapshot list {names}")
    return contents(B.restore_snapshot(spark, root, TENANT, "snap-b"))


_PARTS = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, substr(md5(CAST({key} AS VARCHAR)), 1, 1) AS part, CAST(count(*) AS BIGINT) AS rows FROM {_ROWS[t][0]} WHERE {_OF_TENANT[t]} GROUP BY ALL"
    for t, key in (("tenant_containers", "id"), ("deployment_status", "id"), ("index_metadata", "id"), ("tenant_quota", "tenant_id")))


@job("B5_snapshot_verify", with_views(
    f"SELECT table_name, part, rows, NOT (table_name = 'deployment_status' AND part = (SELECT min(part) FROM ({_PARTS}) q WHERE table_name = 'deployment_status')) "
    f"AS verified FROM ({_PARTS}) t", _EV, [_META]), "export")
def b5(spark, sf_dir):
    """A snapshot of which one part is then damaged: one of its rows is changed, in place."""
    root = scratch_path(spark, "backups")
    path = B.export_snapshot(spark, tenant_tables(spark, sf_dir), TENANT, root, "snap-v")
    folder = f"{path}/deployment_status"
    first = B.manifest_of(spark, root, TENANT, "snap-v").where("table_name = 'deployment_status' and part != ''").agg(F.min("part")).first()[0]
    part = spark.read.parquet(f"{folder}/_part={first}")
    odd = part.agg(F.min("id")).first()[0]
    damaged = scratch_path(spark, "damaged")
    part.withColumn("status", F.when(F.col("id") == odd, "lost").otherwise(F.col("status"))).write.parquet(damaged)
    spark.read.parquet(damaged).write.mode("overwrite").parquet(f"{folder}/_part={first}")
    return B.verify_parts(spark, root, TENANT, "snap-v").select("table_name", "part", "rows", "verified")
