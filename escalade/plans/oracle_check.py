"""Differential check: a registered Spark query against its DuckDB oracle on the same parquet tables.

Mirrors the driver's gate: row count, column names/kinds, order-insensitive multiset of rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import SparkSession

from escalade.sources.tables import TABLES


@dataclass
class CheckResult:
    name: str
    ok: bool
    spark_rows: int
    oracle_rows: int
    detail: str = ""


def _kind(dtype) -> str:
    s = str(dtype).lower()
    if "int" in s:
        return "int"
    if "float" in s or "double" in s:
        return "float"
    if "bool" in s:
        return "bool"
    return "other"


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return repr(v)
    if hasattr(v, "item"):
        return _norm(v.item())
    return repr(v)


def duckdb_connection(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create or replace view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark: SparkSession, name: str, build, sql: str, sf_dir: str, con=None) -> CheckResult:
    con = con or duckdb_connection(sf_dir)
    sdf = build(spark, sf_dir)
    s_rows = [r.asDict(recursive=True) for r in sdf.collect()]
    s_cols = sdf.columns
    o = con.execute(sql)
    o_cols = [d[0] for d in o.description]
    o_rows = [dict(zip(o_cols, r)) for r in o.fetchall()]
    if sorted(s_cols) != sorted(o_cols):
        return CheckResult(name, False, len(s_rows), len(o_rows), f"columns {sorted(s_cols)} vs {sorted(o_cols)}")
    cols = sorted(s_cols)
    s_types = {f.name: _kind(f.dataType.simpleString()) for f in sdf.schema.fields}
    o_types = {c: _kind(t) for c, t in zip(o_cols, [str(d[1]) for d in o.description])}
    bad = [c for c in cols if s_types[c] != o_types[c] and not (s_types[c] == "other" and o_types[c] == "other")]
    if bad:
        return CheckResult(name, False, len(s_rows), len(o_rows),
                           "types " + ", ".join(f"{c}: {s_types[c]} vs {o_types[c]}" for c in bad))
    if len(s_rows) != len(o_rows):
        return CheckResult(name, False, len(s_rows), len(o_rows), "row count")
    key = lambda r: tuple(str(_norm(r[c])) for c in cols)
    a = sorted(key(r) for r in s_rows)
    b = sorted(key(r) for r in o_rows)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return CheckResult(name, False, len(s_rows), len(o_rows), f"values differ, cols={cols}, first={diff}")
    return CheckResult(name, True, len(s_rows), len(o_rows))


def main(argv=None):
    import argparse
    import sys
    import time

    from escalade.plans.catalog import all_queries
    from escalade.session import get_spark

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args(argv)
    spark = get_spark("oracle-check")
    con = duckdb_connection(args.sf_dir)
    qs = all_queries()
    names = [n for n in qs if not args.names or any(n.startswith(p) for p in args.names)]
    bad = 0
    for n in names:
        q = qs[n]
        t0 = time.time()
        if q.oracle is None:
            rows = q.build(spark, args.sf_dir).count()
            print(f"ROWS  {n}: {rows} rows ({time.time() - t0:.1f}s)", flush=True)
            continue
        try:
            r = compare(spark, n, q.build, q.oracle, args.sf_dir, con)
        except Exception as e:  # report and continue
            r = CheckResult(n, False, -1, -1, f"{type(e).__name__}: {str(e)[:400]}")
        bad += not r.ok
        print(f"{'OK  ' if r.ok else 'FAIL'}  {n}: {r.spark_rows}/{r.oracle_rows} {r.detail} ({time.time() - t0:.1f}s)",
              flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    sys.exit(1 if bad else 0)


if __name__ == "__main__":
    main()
