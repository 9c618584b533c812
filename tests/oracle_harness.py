"""Run a registered report in Spark and its oracle SQL in DuckDB; compare rows, columns, values.

Usage: ``python tests/oracle_harness.py [sf_dir] [name ...]``.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if math.isinf(v):
            return v
        if v == int(v) and abs(v) < 1e15:
            return int(v)
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    t2 = time.time()
    ok_cols = sorted(s_cols) == sorted(d_cols)
    ok_n = len(s_rows) == len(d_rows)
    ok_v = ok_cols and ok_n and _rows(s_cols, s_rows) == _rows(d_cols, d_rows)
    detail = ""
    if not ok_cols:
        detail = f"cols spark={sorted(s_cols)} duck={sorted(d_cols)}"
    elif not ok_v:
        a, b = _rows(s_cols, s_rows), _rows(d_cols, d_rows)
        diff_a = [r for r in a if r not in set(b)][:3]
        diff_b = [r for r in b if r not in set(a)][:3]
        detail = f"n={len(s_rows)}/{len(d_rows)} cols={sorted(s_cols)} spark_only={diff_a} duck_only={diff_b}"
    return ok_cols and ok_n and ok_v, len(s_rows), t1 - t0, t2 - t1, detail


def main(argv):
    from minpair.session import build_session
    import __spark_entry__ as e
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    spark = build_session("local[8]", 8)
    con = duck(sf_dir)
    q, o = e.queries(), e.oracle_sql()
    bad = 0
    for name in (names or list(q)):
        if name not in o:
            t0 = time.time()
            n = q[name](spark, sf_dir).count()
            print(f"ROWS-ONLY {name}: {n} rows {time.time() - t0:.1f}s", flush=True)
            continue
        try:
            ok, n, ts, td, detail = compare(spark, con, name, q[name], o[name], sf_dir)
        except Exception as ex:  # report and continue
            ok, n, ts, td, detail = False, -1, 0, 0, f"ERROR {type(ex).__name__}: {str(ex)[:400]}"
        bad += not ok
        print(f"{'OK  ' if ok else 'FAIL'} {name}: {n} rows spark {ts:.1f}s duck {td:.1f}s {detail}", flush=True)
    print(f"{len(names or q) - bad} ok, {bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
