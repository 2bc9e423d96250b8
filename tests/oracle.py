"""Compare registered queries with their SQL on DuckDB.

Run as a script: python tests/oracle.py [sf] [name ...]
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return round(value, 6) + 0.0
    if isinstance(value, Decimal):
        return ("decimal", str(value))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def family(type_name: str) -> str:
    name = type_name.lower()
    for label, words in {
        "integer": ("bigint", "int", "hugeint", "smallint", "tinyint", "long"),
        "double": ("double", "float"),
        "text": ("varchar", "string"),
        "boolean": ("bool",),
        "time": ("timestamp",),
    }.items():
        if any(w in name for w in words):
            return name if "huge" in name else label
    return name


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, folder, entry) -> str:
    """Empty text when equal, else what differs."""
    df = entry.run(spark, folder)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if entry.sql is None:
        return "" if got else "no rows"
    cur = con.execute(entry.sql)
    want_types = {d[0]: str(d[1]) for d in cur.description}
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} and {want_cols}"
    if not got:
        return "no rows"
    for name, kind in df.dtypes:
        if family(kind) != family(want_types[name]):
            return f"type of {name}: {kind} and {want_types[name]}"
    if len(got) != len(want):
        return f"{len(got)} rows, SQL has {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(bad)} of {len(want)} rows differ, first {bad[0]}" if bad else ""


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from brinewave.plans.catalog import ENTRIES
    from brinewave.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    names = sys.argv[2:] or list(ENTRIES)
    folder = f"/root/testdata/sf{sf}"
    spark = build_session(
        master="local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, folder, ENTRIES[name])
        except Exception as error:  # report every query, not only the first that fails
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {time.time() - start:6.2f}s {name} {problem}", flush=True)
    print(f"{len(names) - failed} of {len(names)} equal")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
