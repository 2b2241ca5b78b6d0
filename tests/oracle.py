"""Compare registered queries with their SQL, value by value.

Usage: python tests/oracle.py [data folder] [query …]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if isinstance(v, bool):
        return (1, float(v))
    if isinstance(v, (int, float)):
        return (1, float(v) + 0.0)
    if hasattr(v, "isoformat"):
        return (2, v.isoformat())
    return (2, str(v))


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_value(r[i]) for i in order) for r in rows)


def compare(df, connection, sql):
    """None when equal, else what differs."""
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    expected_rows = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    expected = canonical(names, expected_rows)
    if len(got) != len(expected):
        return f"{len(got)} rows != {len(expected)}"
    bad = [(g, e) for g, e in zip(got, expected, strict=True) if g != e]
    return f"{len(bad)} of {len(got)} rows differ, first: {bad[0]}" if bad else None


def main(folder, names):
    from pyspark.sql import SparkSession

    from candora.catalog import ORACLES, QUERIES

    spark = (
        SparkSession.builder.master(os.environ.get("ORACLE_MASTER", "local[8]"))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    failed = []
    for name in names or QUERIES:
        started = time.time()
        try:
            df = QUERIES[name](spark, folder)
            if name in ORACLES:
                problem = compare(df, connection, ORACLES[name])
                verdict = "ok" if problem is None else f"DIFFERENT {problem}"
            else:
                verdict = f"rows only: {df.count()}"
        except Exception as error:  # report and go on with the next query
            verdict = f"ERROR {type(error).__name__} {str(error)[:700]}"
        if not (verdict == "ok" or verdict.startswith("rows only")):
            failed.append(name)
        print(f"{name:28s} {time.time() - started:6.1f}s {verdict}", flush=True)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:])
