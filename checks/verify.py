"""Run the queries against DuckDB on one folder: ``python -m checks.verify [folder] [names...]``."""

import math
import sys
import time
import traceback

import duckdb

from vitrine.session import build_session

from . import CHECKS
from .base import TABLES


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return names, sorted(out, key=repr)


def compare(spark, con, folder, name):
    query, sql = CHECKS[name]
    df = query(spark, folder)
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "rows only", len(got)
    result = con.execute(sql)
    want_names, want = rows_of([d[0] for d in result.description], result.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}", len(got)
    if got != want:
        extra = [r for r in got if r not in set(want)][:2] if len(got) < 50000 else []
        missing = [r for r in want if r not in set(got)][:2] if len(got) < 50000 else []
        return f"rows {len(got)} != {len(want)}\n  spark {extra}\n  duck  {missing}", len(got)
    return "ok", len(got)


def main():
    args = sys.argv[1:]
    folder = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = args or list(CHECKS)
    spark = build_session("verify", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    failed = []
    for name in names:
        start = time.time()
        try:
            outcome, count = compare(spark, con, folder, name)
        except Exception:
            outcome, count = traceback.format_exc(limit=-2)[-900:], -1
        if outcome not in ("ok", "rows only") or count == 0:
            failed.append(name)
        print(f"{name:32} {count:8} {time.time() - start:6.1f}s {outcome}", flush=True)
    print(f"{len(names) - len(failed)} of {len(names)} good; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
