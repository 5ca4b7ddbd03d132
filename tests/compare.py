"""Runs registered queries beside their SQL in DuckDB and compares values.

    python tests/compare.py [--sf DIR] [names...]
"""

from __future__ import annotations

import argparse
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def rows_of(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted(repr(tuple("~" if v is None or v != v else v for v in row)) for row in pdf.astype(object).values.tolist())


def compare(spark, con, name, fn, sql, sf):
    t0 = time.time()
    got = fn(spark, sf)
    table = got.toPandas()
    sec = time.time() - t0
    if sql is None:
        return f"rows {len(table)}", sec, True
    want = con.execute(sql).df()
    if sorted(table.columns) != sorted(want.columns):
        return f"columns {sorted(table.columns)} != {sorted(want.columns)}", sec, False
    kinds = {c: (table[c].dtype.kind, want[c].dtype.kind) for c in table.columns if table[c].dtype.kind != want[c].dtype.kind}
    a, b = rows_of(table), rows_of(want)
    if a == b:
        return f"ok {len(a)} rows" + (f" kinds {kinds}" if kinds else ""), sec, True
    only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    return f"DIFF {len(a)} vs {len(b)} rows, {len(only_a)} only here {only_a[:3]} {only_b[:3]} kinds {kinds}", sec, False


def main() -> int:
    import duckdb

    import __spark_entry__ as entry
    from foldline.session import build_session

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{args.sf}/{t}.parquet')")
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args.names or queries:
        try:
            text, sec, ok = compare(spark, con, name, queries[name], oracles.get(name), args.sf)
        except Exception as e:
            text, sec, ok = f"ERROR {type(e).__name__}: {str(e)[:600]}", 0.0, False
            if args.names:
                traceback.print_exc()
        bad += not ok
        print(f"{'  ' if ok else '! '}{name:28s} {sec:6.2f}s {text}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
