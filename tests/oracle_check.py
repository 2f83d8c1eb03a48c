"""Compare registered Spark queries with their DuckDB oracle SQL.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Prints one line per query: rows, schema and an order-insensitive value check.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, sf_dir, names=None):
    import __spark_entry__ as e
    qs, orc = e.queries(), e.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in names or sorted(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            rows = [tuple(r) for r in df.collect()]
            cols = df.columns
        except Exception as ex:  # report and continue
            print(f"{name:28s} SPARK ERROR {type(ex).__name__}: {str(ex)[:300]}")
            results[name] = False
            continue
        dt = time.time() - t0
        if name not in orc:
            print(f"{name:28s} rows={len(rows):7d} (no oracle) {dt:.1f}s")
            results[name] = None
            continue
        try:
            cur = con.execute(orc[name])
            ocols = [d[0] for d in cur.description]
            orows = cur.fetchall()
        except Exception as ex:
            print(f"{name:28s} ORACLE ERROR {str(ex)[:300]}")
            results[name] = False
            continue
        same_cols = sorted(cols) == sorted(ocols)
        ok = same_cols and len(rows) == len(orows) and canon(cols, rows) == canon(ocols, orows)
        results[name] = ok
        print(f"{name:28s} rows={len(rows):7d}/{len(orows):7d} cols={'ok' if same_cols else (cols, ocols)} "
              f"{'MATCH' if ok else 'DIFF'} {dt:.1f}s")
        if not ok and same_cols:
            a, b = canon(cols, rows), canon(ocols, orows)
            sa, sb = set(a), set(b)
            print("   spark-only:", list(sa - sb)[:3])
            print("   oracle-only:", list(sb - sa)[:3])
    return results


if __name__ == "__main__":
    from testsieve.session import get_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = get_session("local[8]", 8)
    res = compare(spark, sf, names)
    bad = [k for k, v in res.items() if v is False]
    print("FAILED:", bad)
