"""Views standing in for the control-plane tables the test data lacks.

Each view is deterministic integer arithmetic over the given tables and is
written once; ``spark_view`` builds it as a DataFrame (no global temp view,
so two sessions or scale factors never collide) and ``duckdb_ctes`` renders
the same text as common table expressions for the SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quiver.sources.tables import TABLES, table

# Fixture view definitions (the test-input contract).
VIEWS: dict[str, str] = {
    "fx_metrics": (
        "select event_id as id, concat('ns-', cast(user_id % 20 as string)) as namespace, "
        "cast((event_id*37) % 1000 as double)/10 as cpu_usage, cast((event_id*53) % 1000 as double)/10 as memory_usage, "
        "cast((event_id*71) % 1000 as double)/10 as disk_usage, value as qps, ts from {events}"
    ),
    "fx_ns_deployments": (
        "select concat('ns-', cast(n_nationkey as string)) as namespace, concat('user-', cast(n_nationkey as string)) as user_id, "
        "cast(1 + n_nationkey % 10 as integer) as replicas from {nation} where n_nationkey < 20"
    ),
    "fx_policies": (
        "select concat('user-', cast(s_suppkey as string)) as user_id, s_suppkey % 3 <> 0 as enable_auto_scale_up, "
        "s_suppkey % 4 <> 0 as enable_auto_scale_down, cast(60 + s_suppkey % 30 as double) as scale_up_threshold, "
        "cast(10 + s_suppkey % 30 as double) as scale_down_threshold, cast(3 + s_suppkey % 6 as integer) as max_replicas, "
        "1 as min_replicas from {supplier}"
    ),
    "fx_tenant_containers": (
        "select c_custkey as id, concat('org-', cast(c_nationkey as string)) as tenant_org_id, "
        "concat('user-', cast(c_custkey % 200 as string)) as user_id, concat('svc-', cast(c_custkey as string)) as service_name, "
        "concat('org-', cast(c_nationkey as string), '-user-', cast(c_custkey % 200 as string), '-svc-', cast(c_custkey as string)) as namespace, "
        "cast(1 + c_custkey % 5 as integer) as replicas, concat(cast(250 * (1 + c_custkey % 8) as string), 'm') as cpu, "
        "concat(cast(1 + c_custkey % 4 as string), 'Gi') as memory, 128 as dimension, c_acctbal < 0 as deleted from {customer}"
    ),
    "fx_deployments": (
        "select id, tenant_org_id, namespace, user_id, service_name, replicas, "
        "case when deleted then 'deleted' else 'created' end as status from {fx_tenant_containers}"
    ),
    "fx_replicas": (
        "select namespace, cast(replicas - id % 2 as integer) as ready, replicas as desired from {fx_tenant_containers} where id % 3 <> 0"
    ),
    "fx_tenant_quota": (
        "select concat('user-', cast(s_suppkey as string)) as tenant_id, cast(10 + s_suppkey % 7 as integer) as max_indices, "
        "cast(s_suppkey % 20 as integer) as current_indices from {supplier}"
    ),
    "fx_quota_events": (
        "select event_id as id, concat('user-', cast(user_id % 120 as string)) as tenant_id, event_id % 3 <> 0 as increase from {events}"
    ),
    "fx_requests": (
        "select c_custkey as id, case when c_custkey % 17 = 0 then '' else concat('org-', cast(c_nationkey as string)) end as tenant_org_id, "
        "case when c_custkey % 19 = 0 then '' else concat('user-', cast(c_custkey % 200 as string)) end as user_id, "
        "case when c_custkey % 23 = 0 then '' else concat('svc-', cast(c_custkey as string)) end as service_name, "
        "case when c_custkey % 5 = 0 then 'custom' else '' end as namespace, cast(c_custkey % 4 as integer) as replicas, "
        "case when c_custkey % 3 = 0 then '' else '750m' end as cpu, "
        "case c_custkey % 3 when 0 then '' when 1 then '4' else '2Gi' end as memory, "
        "case c_custkey % 4 when 0 then '' when 1 then '50' else '20Gi' end as disk, "
        "cast((c_custkey % 3) * 64 as integer) as dimension from {customer}"
    ),
    "fx_index_metadata": (
        "select p_partkey as id, concat('idx-', cast(p_partkey as string)) as index_name, "
        "concat('ns-', cast(p_partkey % 20 as string)) as namespace, "
        "case p_partkey % 3 when 0 then 'l2' when 1 then 'cosine' else 'dot' end as metric, "
        "case when p_size % 5 = 0 then 'building' else 'active' end as status, p_size as document_count from {part}"
    ),
    "fx_shards": (
        "select concat('idx-', cast(ix as string)) as index_name, cast(sh as string) as shard, "
        "case when rn = 1 then 'p' else 'r' end as prirep, "
        "case when rn = 1 then 'STARTED' when ix % 11 = 0 then 'UNASSIGNED' when (o_orderkey * 13) % 29 = 1 then 'INITIALIZING' "
        "when (o_orderkey * 13) % 29 = 2 then 'RELOCATING' when (o_orderkey * 13) % 29 = 3 then 'UNASSIGNED' else 'STARTED' end as state, "
        "case when rn = 3 and (o_orderkey * 13) % 29 = 3 then '' else cast(1000 + ix + case when rn = 1 then 0 else (o_orderkey * 7) % 12 end as string) end as docs, "
        "concat(cast(10 + (o_orderkey % 7) % 2 as string), 'mb') as store, concat('node-', cast(o_orderkey % 7 as string)) as node "
        "from (select o_orderkey, o_custkey % 150 as ix, o_orderkey % 6 as sh, "
        "row_number() over (partition by o_custkey % 150, o_orderkey % 6 order by o_orderkey) as rn from {orders}) t where rn <= 3"
    ),
    "fx_recovery_json": (
        "select p_partkey as id, concat('{{\"idx-', cast(p_partkey as string), "
        "'\":{{\"shards\":[{{\"id\":0,\"type\":\"PRIMARY\",\"stage\":\"DONE\",\"source\":{{\"name\":\"node-1\"}},\"target\":{{\"name\":\"node-2\"}},"
        "\"index\":{{\"size\":{{\"recovered_in_bytes\":', cast(p_size * 100 as string), ',\"total_in_bytes\":10000,\"percent\":\"', "
        "cast(p_size as string), '%\"}}}},\"start_time_in_millis\":1704067200000}},{{\"id\":1,\"stage\":\"INDEX\"}}]}}}}') as body from {part}"
    ),
    "fx_pod_usage": (
        "select event_id as id, concat('ns-', cast(event_id % 20 as string)) as namespace, concat('pod-', cast(event_id % 7 as string)) as pod, "
        "case when event_id % 13 = 0 then '2' else concat(cast((event_id*37) % 4000 as string), 'm') end as cpu_text, "
        "case when event_id % 11 = 0 then '1Gi' else concat(cast((event_id*53) % 4096 as string), 'Mi') end as mem_text, "
        "concat(cast((event_id*71) % 101 as string), '%') as disk_text, ts from {events}"
    ),
    "fx_counters": (
        "select event_id as id, concat('ns-', cast(event_id % 20 as string)) as namespace, (event_id * 3) % 5000 as counter, "
        "1000 + event_id % 500 as size_bytes, event_id % 400 as avail_bytes, ts from {events}"
    ),
    "fx_reports": (
        "select event_id as id, concat('user-', cast(user_id as string)) as user_id, concat('svc-', cast(user_id % 3 as string)) as service_name, "
        "case event_id % 11 when 0 then 'starting' when 1 then 'namespace_created' when 2 then 'gitlab_pulled' when 3 then 'k8s_applied' "
        "when 4 then 'resources_configured' when 5 then 'disk_configured' when 6 then 'rollout_completed' when 7 then 'tenant_synced' "
        "when 8 then 'completed' else 'other' end as status, ts from {events}"
    ),
    "fx_logs": (
        "select event_id as line_no, case when event_id % 4 = 0 then concat('2024-01-01 00:00:00.000 I ', event_type) "
        "when event_id % 4 = 1 then concat('  at frame ', cast(event_id as string)) "
        "else concat('{{\"log\":\"', event_type, '\",\"kubernetes\":{{\"namespace_name\":\"', "
        "case when event_id % 3 = 0 then 'search-system' else 'other' end, '\",\"pod_name\":\"pod-', cast(user_id % 10 as string), '\"}}}}') end as raw, "
        "case when event_id % 4 <= 1 then 'elasticsearch' else 'kubernetes' end as tag from {events}"
    ),
    "fx_search_log": (
        "select event_id as query_id, concat('idx-', cast(user_id % 10 as string)) as index_name, value as latency_ms, ts from {events}"
    ),
    "fx_scaled_embeddings": (
        "select vec_id, transform(embedding, x -> cast(x as double) * (1 + vec_id % 5)) as embedding, label from {embeddings}"
    ),
}

DUCKDB_OVERRIDES = {
    "fx_scaled_embeddings": (
        "select vec_id, list_transform(embedding, lambda x: cast(x as double) * (1 + vec_id % 5)) as embedding, label from embeddings"
    ),
}


def _deps(name: str) -> list[str]:
    import string

    return [f for _, f, _, _ in string.Formatter().parse(VIEWS[name]) if f]


def spark_view(spark: SparkSession, sf_dir: str, name: str, _memo: dict | None = None) -> DataFrame:
    memo = {} if _memo is None else _memo
    if name in memo:
        return memo[name]
    if name in TABLES:
        df = table(spark, sf_dir, name)
    else:
        args = {d: spark_view(spark, sf_dir, d, memo) for d in _deps(name)}
        df = spark.sql(VIEWS[name], **args)
    memo[name] = df
    return df


def _order(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str):
        if n in TABLES or n in out:
            return
        for d in _deps(n):
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def duckdb_ctes(names: list[str]) -> list[tuple[str, str]]:
    ctes = []
    for n in _order(names):
        if n in DUCKDB_OVERRIDES:
            text = DUCKDB_OVERRIDES[n]
        else:
            text = VIEWS[n].format(**{d: d for d in _deps(n)})
        ctes.append((n, text))
    return ctes


def with_views(body: str, views: list[str] = (), ctes: list[tuple[str, str]] = (),
               recursive: tuple[str, str] | None = None) -> str:
    """DuckDB SQL: ``WITH [RECURSIVE] <fixture views>, <extra ctes>[, <recursive cte>] <body>``.

    ``recursive`` is ``(header, text)``, e.g. ``("scan(a, b)", "SELECT ... UNION ALL SELECT ...")``.
    """
    parts = [f"{n} AS ({t})" for n, t in duckdb_ctes(list(views)) + list(ctes)]
    if recursive is not None:
        parts.append(f"{recursive[0]} AS ({recursive[1]})")
    if not parts:
        return body
    return ("WITH RECURSIVE " if recursive is not None else "WITH ") + ",\n".join(parts) + "\n" + body
