"""Compares every query that has SQL with DuckDB on one folder of tables: python tests/compare.py [SF_DIR] [NAME...]."""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    same = sorted(df.columns) == sorted(d[0] for d in cur.description) and got == want
    detail = "" if same else f"columns {sorted(df.columns)} / {sorted(d[0] for d in cur.description)}; only here {len(set(got) - set(want))}: {sorted(set(got) - set(want))[:2]}; only there {sorted(set(want) - set(got))[:2]}"
    return same, len(got), len(want), detail


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'; set memory_limit = '6GB'")
    for f in sorted(os.listdir(sf_dir)):
        path = os.path.join(sf_dir, f, "*.parquet") if os.path.isdir(os.path.join(sf_dir, f)) else os.path.join(sf_dir, f)
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{path}'")
    return con


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.001"
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = connect(sf_dir), entry.oracle_sql()
    for name, query in entry.queries().items():
        if args and name not in args:
            continue
        t = time.time()
        try:
            if name in sqls:
                same, n, m, detail = compare(spark, con, name, query, sqls[name], sf_dir)
                print("ok  " if same else "DIFF", name, n, m, round(time.time() - t, 1), detail[:2400], flush=True)
            else:
                print("rows", name, query(spark, sf_dir).count(), round(time.time() - t, 1), flush=True)
        except Exception as e:
            print("FAIL", name, str(e)[:700], flush=True)
