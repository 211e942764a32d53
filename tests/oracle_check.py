"""Run registered queries in Spark and their DuckDB twins; compare results.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from threadlens.sources.tables import TABLES  # noqa: E402


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    try:
        import decimal
        if isinstance(v, decimal.Decimal):
            return round(float(v), 6) + 0.0
    except Exception:
        pass
    return v


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, name, fn, sql, sf_dir, con):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    cols = sorted(sdf.columns)
    srows = [tuple(_norm(r[c]) for c in cols) for r in sdf.collect()]
    t1 = time.time()
    if sql is None:
        return {"name": name, "rows": len(srows), "match": None, "spark_s": round(t1 - t0, 2)}
    rel = con.execute(sql)
    dcols = [d[0] for d in rel.description]
    drows_raw = rel.fetchall()
    if sorted(dcols) != cols:
        return {"name": name, "match": False, "why": f"columns spark={cols} duck={sorted(dcols)}"}
    idx = [dcols.index(c) for c in cols]
    drows = [tuple(_norm(r[i]) for i in idx) for r in drows_raw]
    key = lambda r: tuple((x is None, str(type(x)), str(x)) for x in r)
    ss, dd = sorted(srows, key=key), sorted(drows, key=key)
    ok = ss == dd
    out = {"name": name, "rows": len(srows), "duck_rows": len(drows), "match": ok, "spark_s": round(t1 - t0, 2)}
    if not ok:
        sset, dset = set(map(repr, ss)), set(map(repr, dd))
        out["only_spark"] = [r[:300] for r in list(sset - dset)[:3]]
        out["only_duck"] = [r[:300] for r in list(dset - sset)[:3]]
    return out


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    from threadlens.session import build_session
    import __spark_entry__ as e
    spark = build_session("local[8]", 8)
    qs, oracle = e.queries(), e.oracle_sql()
    con = duck(sf_dir)
    for name in (names or list(qs)):
        try:
            print(compare(spark, name, qs[name], oracle.get(name), sf_dir, con), flush=True)
        except Exception as exc:  # report and continue
            print({"name": name, "error": repr(exc)[:1500]}, flush=True)


if __name__ == "__main__":
    main()
