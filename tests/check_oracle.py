"""Run queries beside their SQL: python tests/check_oracle.py [sf] [query ...]."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from segue.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr(tuple(row[i] for i in order)) for row in rows)


def connect(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return con


def compare(spark, con, sf, name):
    """(verdict, rows, seconds in Spark, seconds in SQL)."""
    start = time.time()
    result = entry.QUERIES[name](spark, sf)
    mine = rows_of(result.columns, [tuple(r) for r in result.collect()])
    took = time.time() - start
    sql = entry.ORACLE.get(name)
    if sql is None:
        return "rows only", len(mine[1]), took, 0.0, ""
    start = time.time()
    cursor = con.execute(sql)
    theirs = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    sql_took = time.time() - start
    if mine == theirs:
        return "equal", len(mine[1]), took, sql_took, ""
    a, b = set(mine[1]), set(theirs[1])
    note = f"{mine[0]} {theirs[0]} rows {len(mine[1])}/{len(theirs[1])}\n   spark {sorted(a - b)[:3]}\n   sql   {sorted(b - a)[:3]}"
    return "DIFFERENT", len(mine[1]), took, sql_took, note


if __name__ == "__main__":
    sf = f"/root/testdata/{sys.argv[1]}"
    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    for name in sys.argv[2:] or entry.QUERIES:
        try:
            verdict, n, took, sql_took, note = compare(spark, con, sf, name)
            print(f"@ {name:26} {verdict:10} rows={n:<8} spark={took:.1f}s sql={sql_took:.1f}s {note[:1500]}", flush=True)
        except Exception as error:  # noqa: BLE001
            print(f"@ {name:26} FAILED {type(error).__name__}: {str(error)[:700]}", flush=True)
