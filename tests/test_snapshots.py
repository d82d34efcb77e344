"""Snapshots by content: what a second one writes, what verification names, and slices by namespace."""

import pytest
from pyspark.sql import functions as F

from quiver.operators import export as B
from quiver.session import list_dir, path_exists, scratch_path


@pytest.fixture(scope="module")
def tables(spark):
    t = spark.createDataFrame([(i, "org-1" if i % 2 else "org-2", f"u{i % 8}", f"n{i % 3}", None if i % 5 == 0 else i * 1.5) for i in range(80)],
                              "id long, tenant_org_id string, user_id string, namespace string, cost double")
    q = spark.createDataFrame([(f"u{i}", i) for i in range(12)], "tenant_id string, max_indices int")
    m = spark.createDataFrame([(i, f"n{i % 4}") for i in range(20)], "id long, namespace string")
    return {"containers": t, "quota": q, "meta": m}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def same(restored, want):
    assert set(restored) == set(want)
    for name, df in want.items():
        assert restored[name].columns == df.columns and rows(restored[name]) == rows(df)


def parts_written(spark, path, table):
    return {n for n in list_dir(spark, f"{path}/{table}") if n.startswith("_part=")}


def test_second_snapshot_writes_only_what_changed(spark, tables):
    root = scratch_path(spark, "snapshots")
    a = B.export_snapshot(spark, tables, "org-1", root, "s1")
    before = parts_written(spark, a, "containers")
    later = tables | {"containers": tables["containers"].withColumn("cost", F.when(F.col("id") == 7, 0.25).otherwise(F.col("cost")))}
    b = B.export_snapshot(spark, later, "org-1", root, "s2")
    md5 = spark.range(1).select(F.substring(F.md5(F.lit("7")), 1, 1)).first()[0]
    assert len(before) > 5 and parts_written(spark, b, "containers") == {f"_part={md5}"} and not parts_written(spark, b, "quota")
    same(B.restore_snapshot(spark, root, "org-1", "s1"), B.tenant_slices(tables, "org-1"))
    same(B.restore_snapshot(spark, root, "org-1", "s2"), B.tenant_slices(later, "org-1"))
    # rows that went are gone, and a later snapshot of the first state refers to the changed part anew
    B.export_snapshot(spark, tables | {"quota": tables["quota"].limit(0)}, "org-1", root, "s3")
    same(B.restore_snapshot(spark, root, "org-1", "s3"), B.tenant_slices(tables | {"quota": tables["quota"].limit(0)}, "org-1"))
    assert all(r.verified for s in ("s1", "s2", "s3") for r in B.verify_parts(spark, root, "org-1", s).collect())


def test_damage_is_named(spark, tables):
    root = scratch_path(spark, "snapshots")
    path = B.export_snapshot(spark, tables, "all", root, "s1")
    names = sorted(parts_written(spark, path, "containers"))
    folder = f"{path}/containers/{names[2]}"
    copy = scratch_path(spark, "copy")
    part = spark.read.parquet(folder)
    part.unionByName(part.limit(1)).write.parquet(copy)  # one row twice
    spark.read.parquet(copy).write.mode("overwrite").parquet(folder)
    bad = [(r.table_name, r.part, r.rows_read - r.rows) for r in B.verify_parts(spark, root, "all", "s1").collect() if not r.verified]
    assert bad == [("containers", names[2][-1], 1)]
    report = {r.table_name: (r.verified, r.damaged) for r in B.verify_snapshot(spark, root, "all", "s1").collect()}
    assert report == {"containers": (False, [names[2][-1]]), "quota": (True, []), "meta": (True, [])}
    # a part that is gone altogether
    spark.createDataFrame([], "id long").write.mode("overwrite").parquet(f"{path}/meta/{sorted(parts_written(spark, path, 'meta'))[0]}")
    assert not {r.table_name: r.verified for r in B.verify_snapshot(spark, root, "all", "s1").collect()}["meta"]


def test_snapshots_of_a_namespace(spark, tables):
    root = scratch_path(spark, "snapshots")
    path = B.export_snapshot(spark, tables, "org-1", root, "s1", namespace="n1")
    assert path_exists(spark, f"{root}/org-1/namespace=n1/s1/_manifest")
    got = B.restore_snapshot(spark, root, "org-1", "s1", namespace="n1")
    own = tables["containers"].where("tenant_org_id = 'org-1' and namespace = 'n1'")
    users = {r.user_id for r in own.collect()}
    assert rows(got["containers"]) == rows(own) and {r.tenant_id for r in got["quota"].collect()} == users
    assert rows(got["meta"]) == rows(tables["meta"].where("namespace = 'n1'"))
    assert [r.snapshot for r in B.list_snapshots(spark, root, "org-1", "n1").collect()] == ["s1"]
    assert B.list_snapshots(spark, root, "org-1").count() == 0 and path.endswith("/s1")
