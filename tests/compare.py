"""Run a query and its SQL side by side on one data folder: python -m tests.compare SF NAME..."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        where = f"{sf_dir}/{t}.parquet"
        if os.path.exists(where):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{where}/*.parquet')" if os.path.isdir(where) and glob.glob(f"{where}/*.parquet") else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{where}')")
    return con


def plain(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime):
        return v.isoformat()
    if isinstance(v, date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    a = rows_of(df.columns, [tuple(r) for r in df.collect()])
    out = con.execute(sql)
    b = rows_of([c[0] for c in out.description], out.fetchall())
    return a, b


def main(sf, names):
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    sf_dir = f"/root/testdata/{sf}"
    con, queries, oracles = duck(sf_dir), e.queries(), e.oracle_sql()
    bad = 0
    for name in names or queries:
        t = time.time()
        try:
            if name in oracles:
                a, b = compare(spark, con, queries[name], oracles[name], sf_dir)
                ok = a == b
                bad += not ok
                print(name, "OK" if ok else "DIFFERS", len(a[1]), len(b[1]), f"{time.time() - t:.1f}s", flush=True)
                if not ok:
                    print("  ", a[0], "\n  ", b[0])
                    sa, sb = set(map(repr, a[1])), set(map(repr, b[1]))
                    print("   spark only", [x[:300] for x in sorted(sa - sb)[:3]], "\n   sql only", [x[:300] for x in sorted(sb - sa)[:3]])
            else:
                df = queries[name](spark, sf_dir)
                n = df.count()
                print(name, "rows", n, f"{time.time() - t:.1f}s", flush=True)
        except Exception as x:
            bad += 1
            print(name, "FAILED", str(x)[:1500], flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
