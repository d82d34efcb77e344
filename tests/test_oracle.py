"""Every registered job against its DuckDB oracle on the smallest scale factor, and the entry smoke check."""

import pytest

import __spark_entry__ as E
from oracle_check import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert [f.name for f in df.schema.fields] == ["query_id", "rank", "doc_id", "score"]


def test_every_job_has_oracle_or_is_iterative():
    jobs, oracle = E.queries(), E.oracle_sql()
    assert set(oracle) <= set(jobs)
    core = {k for k in jobs if k != "pipeline" and not k.startswith("op")}
    assert not core - set(oracle)


@pytest.mark.parametrize("name", sorted(set(E.queries()) - set(E.LLM_JOBS)))
def test_job_matches_oracle(spark, con, name):
    r = compare(spark, con, SF, name, E.queries()[name], E.oracle_sql().get(name))
    assert r["ok"] is not False, r
