"""Run registered queries against their SQL counterparts.

    python -m checks.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks import registry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def session() -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
             .appName("checks").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "12g")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _key(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return repr(v)


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_key(r[i]) for i in order) for r in rows)


def compare(spark, con, sf: str, name: str) -> str:
    start = time.time()
    df = registry.QUERIES[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if name not in registry.ORACLES:
        return f"rows {len(got):>7} {took:5.1f}s"
    con.execute(registry.ORACLES[name])
    names = [d[0] for d in con.description]
    want = con.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS differ: {sorted(df.columns)} / {sorted(names)}"
    a, b = normal(df.columns, got), normal(names, want)
    if a == b:
        return f"ok   {len(got):>7} {took:5.1f}s"
    in_a, in_b = set(a), set(b)
    only_a = [r for r in a if r not in in_b][:2]
    only_b = [r for r in b if r not in in_a][:2]
    return f"DIFF {len(a)} / {len(b)} rows\n   spark {only_a}\n   sql   {only_b}"


def main(argv) -> int:
    registry.load()
    sf = argv[0] if argv else "/root/testdata/sf0.001"
    names = argv[1:] or list(registry.QUERIES)
    spark, con, bad = session(), database(sf), 0
    for name in names:
        try:
            out = compare(spark, con, sf, name)
        except Exception as e:  # report and go on with the next query
            out = "ERROR " + str(e).split("JVM stacktrace")[0][:900]
        bad += not out.startswith(("ok", "rows"))
        print(f"{name:28} {out}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]) > 0)
