"""Run registered queries against their SQL in DuckDB: python tests/oracle.py [folder] [name …]."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

import __spark_entry__ as entry
from tabprep.registry.views import TABLES
from tabprep.session import build_session


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda t: [(v is None, str(type(v)), str(v)) for v in t])


def kind(value):
    return "num" if isinstance(value, (int, float)) and not isinstance(value, bool) else type(value).__name__


def compare(got_cols, got, want_cols, want):
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    a, b = rows_of(got_cols, got), rows_of(want_cols, want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}; {a[:2]} | {b[:2]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ (columns {sorted(got_cols)}), first {bad[0]}"
    mixed = [
        (x, y) for x, y in zip(a, b) if any(type(p) is not type(q) for p, q in zip(x, y) if p is not None and q is not None)
    ]
    return f"types differ: {mixed[0]}" if mixed else ""


def main() -> int:
    args = sys.argv[1:]
    folder = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = build_session(
        "oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    queries, sql = entry.queries(), entry.oracle_sql()
    extra = set(sql) - set(queries)
    failures = [f"sql without query: {extra}"] if extra else []
    for name in args or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            got = [tuple(r) for r in df.collect()]
            took = time.time() - start
            if name in sql:
                cur = con.execute(sql[name])
                cols = [d[0] for d in cur.description]
                problem = compare(df.columns, got, cols, cur.fetchall())
            else:
                problem = ""
        except Exception as error:  # report and go on with the next query
            problem, took, got = f"{type(error).__name__}: {str(error)[:1500]}", time.time() - start, []
        state = "FAIL" if problem else ("ok" if name in sql else "rows")
        print(f"{state:5}{name:28}{len(got):8} rows {took:6.2f}s  {problem}", flush=True)
        if problem:
            failures.append(name)
    print("failures:", failures)
    return 1 if failures else 0


if __name__ == "__main__":
    sys.exit(main())
