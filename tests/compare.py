"""Run named queries against their SQL twins: python tests/compare.py [sf dir] [query ...]"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from __spark_entry__ import oracle_sql, queries  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def database(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir: str, name: str) -> tuple[bool, str]:
    df = queries()[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if name not in oracle_sql():
        return len(got) > 0, f"{len(got)} rows, no twin"
    cur = con.execute(oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {df.columns} / {cols}"
    a, b = canonical(df.columns, got), canonical(cols, want)
    if a == b:
        return True, f"{len(a)} rows"
    x, y = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
    return False, f"{len(a)} / {len(b)} rows; {len(set(a) - set(b))} differ\n   spark {x}\n   sql   {y}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    con = database(sf)
    bad = 0
    for name in sys.argv[2:] or sorted(queries()):
        start = time.time()
        try:
            ok, note = compare(spark, con, sf, name)
        except Exception as e:  # noqa: BLE001
            ok, note = False, "ERROR " + (str(e)[:900] or traceback.format_exc()[-900:])
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print("failed:", bad)
