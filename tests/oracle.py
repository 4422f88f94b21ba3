"""Compare registered queries with their SQL in DuckDB.

    python tests/oracle.py [--sf 0.01] [key ...]
"""

from __future__ import annotations

import argparse
import datetime
import math
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

import __spark_entry__ as entry  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark " \
         "labels conversations".split()
DATA = Path("/root/testdata")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    """Comparable form: floats to 10 significant digits, whole numbers alike in any type."""
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return float(f"{value:.10g}") + 0.0
    if isinstance(value, int):
        return float(f"{float(value):.10g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def multiset(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def compare(spark_df, con, sql):
    got = [tuple(r) for r in spark_df.collect()]
    cursor = con.execute(sql)
    want_columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    got_columns = spark_df.columns
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(got_columns)} vs {sorted(want_columns)}", len(got)
    a, b = multiset(got_columns, got), multiset(want_columns, want)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}", len(got)
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        x, y = wrong[0]
        names = sorted(got_columns)
        parts = [(n, p, q) for n, p, q in zip(names, x, y) if p != q]
        return f"{len(wrong)} rows differ, first {x} | {y} | {parts[:4]}", len(got)
    if not a:
        return "no rows", 0
    return None, len(got)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("keys", nargs="*")
    args = parser.parse_args()
    sf_dir = str(DATA / f"sf{args.sf}")
    from merchantry.session import local_session
    spark = local_session()
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for key in args.keys or queries:
        start = time.time()
        try:
            df = queries[key](spark, sf_dir)
            if key in oracle:
                problem, rows = compare(df, con, oracle[key])
            else:
                rows = df.count()
                problem = None if rows else "no rows"
        except Exception as error:  # noqa: BLE001
            problem, rows = f"{type(error).__name__}: {str(error)[:900]}", -1
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {key:40s} {rows:8d} rows {time.time() - start:6.2f}s"
              f"{'' if key in oracle else '  (no SQL)'} {problem or ''}", flush=True)
    print(f"{bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
