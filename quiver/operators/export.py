"""Tenant-scoped export, restore and verification of table snapshots: B1-B5, S8.

Snapshots stand under ``<root>/<tenant>[/<namespace>]/<name>``.  Every table is cut into
parts by a hash of its key, and a part's content - its rows in any order - has a digest.
A snapshot writes only the parts whose digest the snapshot before it has not; its
``_manifest`` (table, part, rows, digest, path), written last, names for every part the
folder that holds it, in this snapshot or an earlier one; an entry of no part holds
the table's columns.  So a second snapshot of
little-changed tables costs the changes, restoring reads the manifest's folders, and
verification names the damaged part.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiver.session import list_dir, path_exists

ALL_TENANTS = "all"
#: Hexadecimal digits of the key's hash that number a part: 16 parts a digit.
PART_DIGITS = 1
MANIFEST = "table_name string, part string, rows long, digest string, path string"


def part_of(key: Column, digits: int = PART_DIGITS) -> Column:
    return F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, digits)


def part_digests(df: DataFrame, part: str = "_part") -> DataFrame:
    """(part, rows, digest): an order-free digest of every part - the sums of two hashes of its rows."""
    columns = [F.col(f"`{c}`") for c in sorted(df.columns) if c != part]
    total = lambda h: F.sum(h.cast("decimal(38,0)")).cast("string")
    return df.groupBy(F.col(part).alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.concat_ws(":", total(F.xxhash64(*columns)), total(
        F.xxhash64(F.lit("second"), *reversed(columns)))).alias("digest"))


def tenant_slices(tables: dict[str, DataFrame], tenant: str, org_col: str = "tenant_org_id") -> dict[str, DataFrame]:
    """B1/B2: each table restricted to one tenant org (or all tables whole for ``all``).

    Tables without the org column are restricted through the tenant's
    namespaces (``namespace``) or users (``user_id`` / ``tenant_id``); a table
    that none of these can restrict is an error, not an empty export.
    """
    if tenant == ALL_TENANTS:
        return dict(tables)
    owned = [df for df in tables.values() if org_col in df.columns]
    ns = users = None
    for df in owned:
        t = df.where(F.col(org_col) == tenant)
        if "namespace" in df.columns:
            n = t.select("namespace")
            ns = n if ns is None else ns.unionByName(n)
        if "user_id" in df.columns:
            u = t.select("user_id")
            users = u if users is None else users.unionByName(u)
    out = {}
    for name, df in tables.items():
        if org_col in df.columns:
            out[name] = df.where(F.col(org_col) == tenant)
        elif "namespace" in df.columns and ns is not None:
            out[name] = df.join(ns.distinct(), "namespace", "left_semi").select(*df.columns)
        elif "tenant_id" in df.columns and users is not None:
            out[name] = df.join(users.distinct().withColumnRenamed("user_id", "tenant_id"), "tenant_id", "left_semi").select(*df.columns)
        elif "user_id" in df.columns and users is not None:
            out[name] = df.join(users.distinct(), "user_id", "left_semi").select(*df.columns)
        else:
            raise ValueError(f"table {name!r} has no tenant, namespace or user column to restrict it by")
    return out


def namespace_slices(slices: dict[str, DataFrame], namespace: str) -> dict[str, DataFrame]:
    """A tenant's tables restricted to one namespace: rows of that namespace, and of users who have something in it."""
    users = None
    for df in slices.values():
        if {"namespace", "user_id"} <= set(df.columns):
            u = df.where(F.col("namespace") == namespace).select("user_id")
            users = u if users is None else users.unionByName(u)
    out = {}
    for name, df in slices.items():
        user = next((c for c in ("tenant_id", "user_id") if c in df.columns), None)
        if "namespace" in df.columns:
            out[name] = df.where(F.col("namespace") == namespace)
        elif user and users is not None:
            out[name] = df.join(users.distinct().withColumnRenamed("user_id", user), user, "left_semi").select(*df.columns)
        else:
            raise ValueError(f"table {name!r} has no namespace or user column to restrict it by")
    return out


def snapshot_base(root: str, tenant: str, namespace: str | None = None) -> str:
    return "/".join([root.rstrip("/"), tenant, *([f"namespace={namespace}"] if namespace else [])])


def export_snapshot(spark: SparkSession, tables: dict[str, DataFrame], tenant: str, root: str, name: str | None = None,
                    namespace: str | None = None, keys: dict[str, str] | None = None) -> str:
    """B1/B2: the tenant's tables, or those of one of its namespaces, as a snapshot; returns its path.

    ``keys`` names the column by which a table is cut into parts (the first one, unless named).
    A table's rows are read twice, for the digests and for the parts that changed; give written
    tables where that matters."""
    name = name or dt.datetime.now(dt.timezone.utc).strftime("%Y%m%d_%H%M%S")
    base = snapshot_base(root, tenant, namespace)
    path = f"{base}/{name}"
    earlier = [r["snapshot"] for r in list_snapshots(spark, root, tenant, namespace).collect() if r["snapshot"] < name]
    known = spark.read.schema(MANIFEST).parquet(f"{base}/{max(earlier)}/_manifest") if earlier else spark.createDataFrame([], MANIFEST)
    slices = tenant_slices(tables, tenant)
    manifest = None
    for table, df in (namespace_slices(slices, namespace) if namespace else slices).items():
        df = df.withColumn("_part", part_of(F.col(f"`{(keys or {}).get(table, df.columns[0])}`")))
        now = part_digests(df)
        before = known.where(F.col("table_name") == table).select("part", "rows", "digest", F.col("path").alias("held"))
        entries = now.join(before, ["part", "rows", "digest"], "left")
        # at most 16 ** PART_DIGITS names of parts
        changed = [r["part"] for r in entries.where("held is null").select("part").collect()]
        df.where(F.col("_part").isin(changed)).repartition("_part").write.mode("overwrite").partitionBy("_part").parquet(f"{path}/{table}")
        m = entries.select(F.lit(table).alias("table_name"), "part", "rows", "digest", F.coalesce("held", F.lit(f"{path}/{table}")).alias("path"))
        # the table itself: an entry of no part, with its columns
        m = m.unionByName(spark.createDataFrame([(table, "", 0, df.schema.json(), f"{path}/{table}")], MANIFEST))
        manifest = m if manifest is None else manifest.unionByName(m)
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/_manifest")
    return path


def manifest_of(spark: SparkSession, root: str, tenant: str, name: str, namespace: str | None = None) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{snapshot_base(root, tenant, namespace)}/{name}/_manifest")


def list_snapshots(spark: SparkSession, root: str, tenant: str, namespace: str | None = None) -> DataFrame:
    """B4 without a name: the snapshots of a tenant (or of one of its namespaces) that have a manifest."""
    base = snapshot_base(root, tenant, namespace)
    names = [n for n in list_dir(spark, base) if path_exists(spark, f"{base}/{n}/_manifest")]
    return spark.createDataFrame([(tenant, namespace, n) for n in names], "tenant string, namespace string, snapshot string")


def _parts(spark: SparkSession, root: str, tenant: str, name: str, namespace: str | None) -> dict[str, DataFrame]:
    """The tables of a snapshot with their parts' names in ``_part``, read from the folders that the manifest names."""
    columns, held = {}, {}
    for r in manifest_of(spark, root, tenant, name, namespace).collect():  # tables times parts
        if r["part"]:
            held.setdefault(r["table_name"], {}).setdefault(r["path"], []).append(r["part"])
        else:
            columns[r["table_name"]] = T.StructType.fromJson(json.loads(r["digest"]))
    out = {}
    for table, schema in columns.items():
        whole = spark.createDataFrame([], schema)
        for path, parts in held.get(table, {}).items():
            if path_exists(spark, path):
                whole = whole.unionByName(spark.read.schema(schema).parquet(path).where(F.col("_part").isin(parts)).select(*schema.names))
        out[table] = whole
    return out


def restore_snapshot(spark: SparkSession, root: str, tenant: str, name: str, namespace: str | None = None) -> dict[str, DataFrame]:
    """The tables of a named snapshot."""
    return {table: df.drop("_part") for table, df in _parts(spark, root, tenant, name, namespace).items()}


def verify_parts(spark: SparkSession, root: str, tenant: str, name: str, namespace: str | None = None) -> DataFrame:
    """(table_name, part, rows, rows_read, verified) for every part: what is read against the manifest."""
    got = None
    for table, df in _parts(spark, root, tenant, name, namespace).items():
        d = part_digests(df).select(F.lit(table).alias("table_name"), "part", F.col("rows").alias("rows_read"), F.col("digest").alias("digest_read"))
        got = d if got is None else got.unionByName(d)
    want = manifest_of(spark, root, tenant, name, namespace).where("part != ''")
    same = F.col("rows").eqNullSafe(F.col("rows_read")) & F.col("digest").eqNullSafe(F.col("digest_read"))
    return want.join(got.where("part != ''"), ["table_name", "part"], "full").select(
        "table_name", "part", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("rows_read", F.lit(0)).alias("rows_read"), same.alias("verified"))


def verify_snapshot(spark: SparkSession, root: str, tenant: str, name: str, namespace: str | None = None) -> DataFrame:
    """(table_name, rows, verified, damaged): each table as a whole, with the names of its damaged parts."""
    tables = manifest_of(spark, root, tenant, name, namespace).groupBy("table_name").agg(F.sum("rows").alias("rows"))
    bad = verify_parts(spark, root, tenant, name, namespace).where("not verified").groupBy("table_name").agg(F.sort_array(F.collect_list("part")).alias("damaged"))
    return tables.join(bad, "table_name", "left").select("table_name", "rows", F.col("damaged").isNull().alias("verified"),
                                                         F.coalesce("damaged", F.array().cast("array<string>")).alias("damaged"))


def json_report(df: DataFrame, report_type: str, ts_col: str | None = None) -> DataFrame:
    """Each row as an envelope ``{type, timestamp, data}`` in a JSON text column."""
    ts = F.date_format(F.col(ts_col), "yyyy-MM-dd'T'HH:mm:ss'Z'") if ts_col else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    data = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(F.to_json(F.struct(F.lit(report_type).alias("type"), ts.alias("timestamp"), data.alias("data"))).alias("report"))


def write_json_reports(reports: DataFrame, path: str) -> None:
    reports.write.mode("append").text(path)
