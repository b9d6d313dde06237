"""Spark vs DuckDB comparison for registered queries.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Compares sorted column names, row counts and the multiset of rows (values
canonicalised: decimals and floats to rounded floats, timestamps to ISO text).
"""
from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time
from collections import Counter

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def canon(v):
    if v is None:
        return None
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (decimal.Decimal, float)):
        return round(float(v), 9)
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return canon(v.item())
        except Exception:
            pass
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, dt.timedelta):
        return v.total_seconds()
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, canon(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return canon(v.asDict())
    return v


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(canon(r[i]) for i in order) for r in records)


def compare(spark, con, name, fn, sql, sf_dir):
    t = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    ts = time.time() - t
    if sql is None:
        return {"name": name, "ok": None, "rows": len(s_rows), "spark_s": round(ts, 2)}
    t = time.time()
    res = con.execute(sql)
    o_cols = [d[0] for d in res.description]
    o_rows = res.fetchall()
    to = time.time() - t
    out = {"name": name, "rows": len(s_rows), "oracle_rows": len(o_rows),
           "spark_s": round(ts, 2), "oracle_s": round(to, 2)}
    if sorted(s_cols) != sorted(o_cols):
        out.update(ok=False, why=f"columns {sorted(s_cols)} vs {sorted(o_cols)}")
        return out
    a, b = rows_of(s_cols, s_rows), rows_of(o_cols, o_rows)
    if a != b:
        only_s = list((a - b).items())[:3]
        only_o = list((b - a).items())[:3]
        out.update(ok=False, why=f"spark-only {only_s} oracle-only {only_o}")
        return out
    out["ok"] = True
    return out


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    import __spark_entry__ as E
    if os.environ.get("BARE"):  # a default session, as the driver may create it
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
                 .config("spark.ui.showConsoleProgress", "false").getOrCreate())
        spark.sparkContext.setLogLevel("ERROR")
    else:
        from guestflow.session import build_session
        spark = build_session(shuffle_partitions=8)
    con = duck(sf_dir)
    qs, orc = E.queries(), E.oracle_sql()
    bad = 0
    for name in (names or list(qs)):
        try:
            r = compare(spark, con, name, qs[name], orc.get(name), sf_dir)
        except Exception as exc:  # report and continue
            r = {"name": name, "ok": False, "why": f"{type(exc).__name__}: {str(exc)[:600]}"}
        bad += r.get("ok") is False
        print(r, flush=True)
    print(f"FAILED {bad}" if bad else "ALL OK")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
