"""Run jobs in Spark and their oracle SQL in DuckDB; compare rows exactly.

usage: python tests/oracle_check.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from quiver.sources.tables import TABLES  # noqa: E402

STRICT = os.environ.get("ORACLE_STRICT") == "1"


def canon(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v if STRICT else round(v, 9)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), canon(x)) for k, x in v.items()))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if hasattr(v, "asDict"):
        return tuple(canon(x) for x in v)
    return v


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, sf_dir, name, fn, sql):
    t0 = time.time()
    df = fn(spark, sf_dir)
    cols = df.columns
    srows = [tuple(canon(r[c]) for c in cols) for r in df.collect()]
    ts = time.time() - t0
    if sql is None:
        return dict(name=name, ok=None, rows=len(srows), spark_s=round(ts, 2))
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    if sorted(dcols) != sorted(cols):
        return dict(name=name, ok=False, why=f"columns spark={cols} duck={dcols}")
    idx = [dcols.index(c) for c in cols]
    drows = [tuple(canon(r[i]) for i in idx) for r in drows]
    key = lambda r: tuple((x is None, str(type(x)), str(x)) for x in r)
    a, b = sorted(srows, key=key), sorted(drows, key=key)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return dict(name=name, ok=False, why=f"rows spark={len(a)} duck={len(b)} first diffs {diff}")
    return dict(name=name, ok=True, rows=len(a), spark_s=round(ts, 2))


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    prefixes = [a for a in argv[1:] if not a.startswith("/")]
    from quiver.session import get_session

    import __spark_entry__ as E

    import json

    conf = {"spark.sql.shuffle.partitions": "8", **json.loads(os.environ.get("ORACLE_CONF", "{}"))}
    spark = get_session("local[8]", conf=conf)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    jobs, oracle = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in jobs.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            r = compare(spark, con, sf_dir, name, fn, oracle.get(name))
        except Exception as ex:  # noqa: BLE001
            r = dict(name=name, ok=False, why=f"{type(ex).__name__}: {str(ex)[:400]}")
        bad += r.get("ok") is False
        print(r, flush=True)
    print(f"failures: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
