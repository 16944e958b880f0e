"""Run registered queries beside their SQL and compare rows, columns and values.

    python tests/oracle_compare.py [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def _norm(v):
    if hasattr(v, "is_finite") and not isinstance(v, float):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if v == int(v) if math.isfinite(v) else False:
            return int(v)
        return v
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, bool):
        return v
    return v


def rows_of(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in data]
    out.sort(key=lambda r: tuple((x is not None, str(type(x)) if isinstance(x, str) else "n", x if isinstance(x, str) else str(x)) for x in r))
    return [cols[i] for i in order], out


def compare(df, con, sql) -> tuple[bool, str]:
    res = con.execute(sql)
    ocols, orows = rows_of([d[0] for d in res.description], res.fetchall())
    scols, srows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if ocols != scols:
        return False, f"columns differ: spark {scols} sql {ocols}"
    if len(orows) != len(srows):
        return False, f"rows differ: spark {len(srows)} sql {len(orows)}"
    bad = [(a, b) for a, b in zip(srows, orows) if a != b]
    if bad:
        so, oo = set(srows), set(orows)
        only_s, only_o = [r for r in srows if r not in oo], [r for r in orows if r not in so]
        return False, f"{len(only_s)} of {len(srows)} rows differ, e.g.\n   cols {scols}\n   spark {only_s[:3]}\n   sql   {only_o[:3]}"
    return True, f"{len(srows)} rows"


def main() -> int:
    import __spark_entry__ as entry
    from wakeline.session import local_session

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark = local_session()
    con = connect(args.sf)
    qs, sql = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in qs.items():
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        t0 = time.time()
        try:
            df = fn(spark, args.sf)
            if name not in sql:
                ok, note = True, f"{df.count()} rows, no SQL"
            else:
                ok, note = compare(df, con, sql[name])
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t0:.1f}s {note}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
