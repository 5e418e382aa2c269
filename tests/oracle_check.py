"""Compare each registered query with its DuckDB SQL on the same tables.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Prints one line per query: rows, columns and values equal or not. With
VITRINE_EXACT=1 doubles must match bit for bit (otherwise to 6 decimals).
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


EXACT = os.environ.get("VITRINE_EXACT") == "1"   # compare doubles bit for bit


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float.hex(v) if EXACT else round(v, 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat(sep=" ") if isinstance(v, dt.datetime) else v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    return v


def canon(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    out.sort(key=lambda r: tuple((x is None, str(x)) for x in r))
    return cols, out


def compare(spark, con, name: str, fn, sql: str | None, sf_dir: str) -> dict:
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = {"name": name, "spark_rows": len(s_rows), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    cur = con.cursor()
    rel = cur.execute(sql)
    d_cols = [d[0] for d in rel.description]
    d_rows = rel.fetchall()
    res["duck_rows"] = len(d_rows)
    sc, sr = canon(s_cols, s_rows)
    dc, dr = canon(d_cols, d_rows)
    res["cols_equal"] = sc == dc
    res["values_equal"] = sr == dr
    if not res["cols_equal"]:
        res["cols"] = (sc, dc)
    elif not res["values_equal"]:
        diff_s = [r for r in sr if r not in set(dr)][:3]
        diff_d = [r for r in dr if r not in set(sr)][:3]
        res["diff"] = (diff_s, diff_d)
    res["status"] = "ok" if res["cols_equal"] and res["values_equal"] and len(sr) == len(dr) else "MISMATCH"
    return res


def main(argv: list[str]) -> int:
    from vitrine.session import build_session
    import __spark_entry__ as entry

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or sorted(entry.queries())
    spark = build_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for n in names:
        try:
            r = compare(spark, con, n, qs[n], sqls.get(n), sf_dir)
        except Exception as exc:  # report and go on
            r = {"name": n, "status": "ERROR", "error": repr(exc)[:600]}
        bad += r["status"] not in ("ok", "rows-only")
        print(r, flush=True)
    print(f"SUMMARY {len(names) - bad} of {len(names)} match"
          f"{' bit for bit' if EXACT else ' (6 decimals)'} at {sf_dir}", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
