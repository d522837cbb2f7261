"""python tests/compare.py [names]: registered queries against their SQL twins, at sf0.01."""

import datetime
import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def tables(con, d):
    for p in glob.glob(f"{d}/*.parquet"):
        con.sql(f"CREATE OR REPLACE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")


def plain(v):
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    if hasattr(v, "as_tuple"):
        return repr(float(v))
    return str(v)


def compare(spark, con, name, f, sql, d):
    """None if both give the same rows, else what differs."""
    df = f(spark, d)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(v) for v in r) for r in df.select(*(f"`{c}`" for c in cols)).collect())
    rel = con.sql(sql)
    if sorted(rel.columns) != cols:
        return f"columns {cols} {sorted(rel.columns)}"
    want = sorted(tuple(plain(v) for v in r) for r in rel.select(*(duckdb.ColumnExpression(c) for c in cols)).fetchall())
    if got == want:
        return None
    more = [r for r in got if r not in set(want)][:2], [r for r in want if r not in set(got)][:2]
    return f"{len(got)} and {len(want)} rows of {cols}; only here {more[0]}; only there {more[1]}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    from sparkloom.plans.registry import ORACLES, QUERIES

    d = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    tables(con, d)
    for name in sys.argv[1:] or QUERIES:
        t = time.time()
        try:
            said = compare(spark, con, name, QUERIES[name], ORACLES[name], d) if name in ORACLES else f"rows {QUERIES[name](spark, d).count()}"
        except Exception as e:  # noqa: BLE001
            said = f"ERROR {type(e).__name__} {str(e)[:600]}"
        print(f"{time.time() - t:6.1f} {name}: {said or 'ok'}"[:1100], flush=True)
