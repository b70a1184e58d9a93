"""Run registered queries beside their SQL oracle: ``python tests/oracle.py DIR [name ...]``."""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_cell(v) for v in value) + "]"
    return repr(value) if value is None else f"{type(value).__name__}:{value}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    """Error text, or None when both sides agree."""
    df = fn(spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        if unwanted in plan:
            return f"plan holds {unwanted}", -1
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None, len(got)
    cur = con.execute(sql)
    want_cols, want = rows_of([c[0] for c in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}", len(got)
    if got != want:
        a, b = set(got) - set(want), set(want) - set(got)
        return (f"rows {len(got)} vs {len(want)}; only spark {sorted(a)[:2]}; "
                f"only sql {sorted(b)[:2]}")[:1500], len(got)
    return None, len(got)


def main() -> int:
    sf_dir, names = sys.argv[1], sys.argv[2:]
    from postmill.bindings import load
    from postmill.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = load()
    con = connect(sf_dir)
    bad = 0
    for name in names or list(queries):
        start = time.time()
        try:
            problem, n = compare(spark, con, name, queries[name], oracles.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001 - report and go on
            problem, n = f"{type(exc).__name__}: {str(exc)[:1500]}", -1
        mark = "FAIL" if problem else ("ok" if name in oracles else "rows-only")
        print(f"{mark:9} {name:28} {n:7} rows {time.time() - start:6.2f}s {problem or ''}", flush=True)
        bad += bool(problem)
    print(f"{bad} failures")
    return bad


if __name__ == "__main__":
    sys.exit(main())
