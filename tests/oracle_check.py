"""Runs registered queries beside their SQL twins: python -m tests.oracle_check [sf_dir] [name ...]"""

from __future__ import annotations

import datetime
import decimal
import sys
import time
from collections import Counter

import duckdb

import __spark_entry__ as entry
from stmtflow.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, decimal.Decimal):
        return str(value)
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(plain(r[i]) for i in order) for r in rows)


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def compare(spark, con, folder, name):
    """(matches, rows, note)"""
    df = entry.queries()[name](spark, folder)
    columns, got = bag(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    n = sum(got.values())
    if sql is None:
        return None, n, "no SQL twin"
    result = con.execute(sql)
    names, want = bag([d[0] for d in result.description], result.fetchall())
    if columns != names:
        return False, n, f"columns {columns} != {names}"
    if got != want:
        extra = list((got - want).items())[:3]
        missing = list((want - got).items())[:3]
        return False, n, f"want {sum(want.values())} rows; extra {extra}; missing {missing}"
    return True, n, ""


def main():
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = build_session(
        "oracle-check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            ok, n, note = compare(spark, con, folder, name)
        except Exception as exc:  # noqa: BLE001 - report and go on
            ok, n, note = False, -1, f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += ok is False
        print(f"{'ok ' if ok else '-- ' if ok is None else 'BAD'} {name:28s} {n:8d} {time.time() - start:6.1f}s {note}", flush=True)
    print(f"{bad} bad of {len(names)}")


if __name__ == "__main__":
    main()
