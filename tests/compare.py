"""Run queries next to their SQL counterparts: ``python tests/compare.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def difference(spark, con, sf_dir, fn, sql) -> str | None:
    df = fn(spark, sf_dir)
    left = canonical(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    right = canonical([d[0] for d in cur.description], cur.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} / {right[0]}"
    if left[1] != right[1]:
        odd = [(a, b) for a, b in zip(left[1], right[1]) if a != b][:3]
        return f"{len(left[1])} / {len(right[1])} rows, first differences {odd}"
    return None


def session(cpus: int = 8):
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("ledgerlint")
             .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = session(), connection(sf_dir)
    sqls, bad = oracle_sql(), 0
    for name, fn in queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            if name in sqls:
                found = difference(spark, con, sf_dir, fn, sqls[name])
            else:
                found = f"no SQL; {fn(spark, sf_dir).count()} rows"
        except Exception as e:  # report and go on
            found = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += found is not None and not found.startswith("no SQL")
        print(f"{name:32s} {time.time() - start:6.1f}s  {found or 'ok'}", flush=True)
    print("failed:", bad)
