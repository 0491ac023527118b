"""Runs registered queries beside their SQL in DuckDB: python tests/oracle.py [sf_dir] [name ...]."""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


def compare(spark, con, sf_dir, f, sql):
    """Empty if both give the same rows, else what differs."""
    df = f(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    want = rows(names, cur.fetchall())
    if got != want:
        a, b = set(got) - set(want), set(want) - set(got)
        return f"{len(got)} and {len(want)} rows; only here {sorted(a)[:2]}; only there {sorted(b)[:2]}"[:700]
    return "" if got else "no rows"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con, oracle = connect(sf_dir), e.oracle_sql()
    start = sys.argv[2][1:] if sys.argv[2:] and sys.argv[2][0] == "+" else ""
    names = list(e.queries())
    if start:
        sys.argv[2:] = [n for n in names[names.index(start):] if n in oracle]
    for name, f in e.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:] or not sys.argv[2:] and name not in oracle:
            continue
        t = time.time()
        try:
            said = compare(spark, con, sf_dir, f, oracle[name]) if name in oracle else f"{f(spark, sf_dir).count()} rows, no SQL"
        except Exception as x:
            said = f"{type(x).__name__} {str(x)[:300]}"
        if said or time.time() - t > 5:
            print(f"{name} {time.time() - t:.1f}s: {said}", flush=True)
    print("done", len(oracle), "of", len(e.queries()))
