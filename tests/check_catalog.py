"""Compare registered queries with their SQL counterparts.

    python tests/check_catalog.py [--sf /path] [name ...]
"""

from __future__ import annotations

import argparse
import math
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return int(value)
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        number = float(value)
        return round(number, 9)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(sf: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return con


def compare(name, spark, con, sf, queries, oracles):
    """(ok, note) of one query."""
    start = time.time()
    df = queries[name](spark, sf)
    got = rows_of(df.columns, df.collect())
    took = time.time() - start
    if name not in oracles:
        return True, f"rows only: {len(got)} rows in {took:.1f}s"
    start = time.time()
    cur = con.execute(oracles[name])
    columns = [d[0] for d in cur.description]
    want = rows_of(columns, cur.fetchall())
    sql = time.time() - start
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(columns)}"
    if got != want:
        diff = [(a, b) for a, b in zip(got, want, strict=False) if a != b][:2]
        return False, f"{len(got)} vs {len(want)} rows; columns {sorted(columns)}; first differences {diff}"
    return True, f"{len(got)} rows in {took:.1f}s (sql {sql:.1f}s)"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    spark, con = session(), duck(args.sf)
    bad = 0
    for name in queries:
        if args.names and not any(n in name for n in args.names):
            continue
        try:
            ok, note = compare(name, spark, con, args.sf, queries, oracles)
        except Exception as exc:  # noqa: BLE001 - report and go on to the next query
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, "-", note, flush=True)
    print(f"{bad} failures")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
