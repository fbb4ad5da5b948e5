"""Compare registered queries with their SQL on DuckDB."""

from __future__ import annotations

import glob
import math
import os
import time

import duckdb

from __spark_entry__ import oracle_sql, queries


def connect(path: str):
    con = duckdb.connect()
    for f in glob.glob(f"{path}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _norm(v):
    if v is None:
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str(v)


def _kind(v):
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "int"
    return type(v).__name__


def compare(spark, con, name: str, path: str, build=None, sql: str | None = None) -> dict:
    """Row counts and the rows on which the two engines differ."""
    started = time.time()
    df = (build or queries()[name])(spark, path)
    got = df.collect()
    seconds = time.time() - started
    cols = sorted(df.columns)
    out = {"name": name, "rows": len(got), "seconds": round(seconds, 2), "ok": True, "why": ""}
    sql = sql or oracle_sql().get(name)
    if not sql:
        return out | {"ok": False, "why": "there is no SQL to compare with"}
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = res.fetchall()
    if sorted(names) != cols:
        return out | {"ok": False, "why": f"columns {cols} vs {sorted(names)}"}
    order = [names.index(c) for c in cols]
    a = sorted(tuple(_norm(r[c]) for c in cols) for r in got)
    b = sorted(tuple(_norm(r[i]) for i in order) for r in want)
    if a != b:
        only_a = list(set(a) - set(b))[:3]
        only_b = list(set(b) - set(a))[:3]
        return out | {"ok": False, "why": f"{len(a)} vs {len(b)} rows; spark {only_a}; sql {only_b}"}
    if got and want:
        ka = {c: _kind(got[0][c]) for c in cols}
        kb = {c: _kind(want[0][i]) for c, i in zip(cols, order)}
        if ka != kb:
            return out | {"ok": False, "why": f"types {ka} vs {kb}"}
    return out


if __name__ == "__main__":
    import sys

    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    path = sys.argv[1]
    con = connect(path)
    names = sys.argv[2:] or list(oracle_sql())
    bad = 0
    for name in names:
        try:
            r = compare(spark, con, name, path)
        except Exception as e:  # report and go on
            r = {"name": name, "ok": False, "rows": -1, "seconds": 0, "why": str(e)[:900]}
        bad += not r["ok"]
        print("ok " if r["ok"] else "BAD", r["name"], r["rows"], r["seconds"], r["why"], flush=True)
    print("bad:", bad)
