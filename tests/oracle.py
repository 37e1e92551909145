"""Run registered queries against their DuckDB statement and compare values.

``python -m tests.oracle [--sf 0.01] [name-prefix ...]``
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = "/root/testdata"


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    from riskframe.plans.catalogue import TABLES

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    """One spelling per value, whatever engine it came from."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0 if value != 0 else 0.0
    if isinstance(value, dt.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def compare(spark, con, folder, name, fn, sql):
    df = fn(spark, folder)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return len(got), None
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return len(got), f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return len(got), f"rows {len(got)} != {len(want)}\n   got {got[:2]}\n  want {want[:2]}"
    bad = [(a, b) for a, b in zip(got, want) if repr(a) != repr(b)]
    if bad:
        return len(got), f"{len(bad)} of {len(got)} rows differ\n   got {bad[0][0]}\n  want {bad[0][1]}"
    return len(got), None


def main(argv=None) -> int:
    import __spark_entry__ as entry
    from riskframe.session import local_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args(argv)
    folder = f"{DATA}/sf{args.sf}"
    spark, con = local_session(8, "oracle"), connection(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    failed = []
    for name, fn in queries.items():
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        start = time.time()
        try:
            n, problem = compare(spark, con, folder, name, fn, oracles.get(name))
        except Exception as exc:  # report and go on with the rest
            n, problem = 0, f"{type(exc).__name__}: {str(exc)[:1500]}"
        kind = "sql " if name in oracles else "rows"
        empty = " EMPTY" if n == 0 else ""
        print(f"{'FAIL' if problem else 'ok  '} {kind} {name:45s} {n:8d} rows {time.time() - start:6.1f}s{empty}", flush=True)
        if problem:
            failed.append(name)
            print("  ", problem, flush=True)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
