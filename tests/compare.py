"""Run registered queries beside their oracle SQL and compare whole results."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from datasets.views import TABLES  # noqa: E402


TIMES: dict[str, float] = {}


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(value):
    if value is None:
        return "NULL"
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else f"{value:.6f}".replace("-0.000000", "0.000000")
    if hasattr(value, "as_tuple"):
        return f"{float(value):.6f}"
    return str(value)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(_norm(r[n]) for n in names) for r in df.collect())


def duck_rows(con, sql):
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return ([columns[i] for i in order],
            sorted(tuple(_norm(r[i]) for i in order) for r in cur.fetchall()))


def difference(spark, con, key, query, oracle, sf_dir):
    """None when equal, otherwise a short description."""
    t = time.time()
    got_names, got = spark_rows(query(spark, sf_dir))
    TIMES[key] = time.time() - t
    if oracle is None:
        return None, len(got)
    want_names, want = duck_rows(con, oracle)
    if got_names != want_names:
        return f"columns {got_names} != {want_names}", len(got)
    if got != want:
        in_got, in_want = set(got), set(want)
        only_got = [r for r in got if r not in in_want][:2]
        only_want = [r for r in want if r not in in_got][:2]
        return (f"rows {len(got)} vs {len(want)}; names {got_names}\n   spark  {only_got}\n   duckdb {only_want}")[:3000], len(got)
    return None, len(got)


def main() -> None:
    """python tests/compare.py SF [module-or-key ...]"""
    import importlib

    from catalog import registry
    from mailquarry.session import local_session

    sf_dir = f"/root/testdata/{sys.argv[1]}"
    names = sys.argv[2:]
    modules = [n for n in names if n in registry.MODULES]
    if names and len(modules) == len(names):
        for m in modules:
            importlib.import_module(f"catalog.{m}")
        keys = list(registry.QUERIES)
    else:
        registry.load_all()
        keys = names or list(registry.QUERIES)
    spark = local_session()
    con = duck(sf_dir)
    bad = 0
    for key in keys:
        t = time.time()
        try:
            diff, n = difference(spark, con, key, registry.QUERIES[key], registry.ORACLES.get(key), sf_dir)
        except Exception as e:  # noqa: BLE001
            diff, n = f"{type(e).__name__}: {str(e)[:1500]}", -1
        status = "ok" if diff is None else "FAIL"
        bad += diff is not None
        kind = "" if key in registry.ORACLES else " (rows only)"
        print(f"{status:5s}{key}{kind} rows={n} {TIMES.get(key, -1):.1f}s of {time.time() - t:.1f}s" + ("" if diff is None else f"\n   {diff}"), flush=True)
    print(f"{len(keys)} checked, {bad} failed")


if __name__ == "__main__":
    main()
