"""Run registered queries next to their SQL in DuckDB: ``python tests/oracle.py [sf] [name …]``."""

from __future__ import annotations

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


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def normal(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(normal(r[i]) for i in order) for r in rows)


def family(name):
    name = name.lower()
    if "int" in name or name in ("long", "short", "byte"):
        return "int"
    if name in ("double", "float") or name.startswith("decimal"):
        return "double" if not name.startswith("decimal") else "decimal"
    return {"varchar": "string"}.get(name, name)


def compare(spark, con, run, sql, sf_dir):
    """None when equal, otherwise what differs."""
    df = run(spark, sf_dir)
    got_types = {n: family(t) for n, t in df.dtypes}
    got = rows_of(df.columns, df.collect())
    rel = con.sql(sql)
    want_types = {n: family(str(t)) for n, t in zip(rel.columns, rel.types)}
    want = rows_of(rel.columns, rel.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} / {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} / {len(want[1])}"
    if got[1] != want[1]:
        bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
        return f"{len(bad)} of {len(want[1])} rows differ: {bad[:3]}"
    if got_types != want_types:
        return f"types {[(k, got_types[k], want_types[k]) for k in got_types if got_types[k] != want_types[k]]}"
    return None


def main():
    import __spark_entry__ as entry
    from cohortloom.session import build_session

    sf_dir = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.01'}"
    spark = build_session()
    con = connect(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            if name in sql:
                problem = compare(spark, con, queries[name], sql[name], sf_dir)
                note = "ok" if problem is None else f"DIFFERS {problem}"
            else:
                note = f"rows {queries[name](spark, sf_dir).count()}"
                problem = None
        except Exception as error:  # noqa: BLE001
            problem = note = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{name:32s} {time.time() - start:6.2f}s {note}", flush=True)
    print("failed", failed)


if __name__ == "__main__":
    main()
