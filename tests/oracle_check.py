"""Compare registered queries with their SQL oracles: python tests/oracle_check.py [regex] [sf_dir]."""

import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import duckdb
import pandas as pd

import __spark_entry__ as entry
from quirefold.plans.fixtures import DRIVER_TABLES
from quirefold.session import local_session


def canon(d):
    d = d[sorted(d.columns)].copy()

    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return "NULL"
        if isinstance(v, float):
            return f"{v + 0.0:.9g}"
        return str(v)

    for c in d.columns:
        d[c] = [cell(v) for v in d[c].tolist()]
    return list(d.columns), sorted(map(tuple, d.values.tolist()))


def main():
    pat = re.compile(sys.argv[1] if len(sys.argv) > 1 else ".")
    sf = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.01"
    spark = local_session()
    spark.sparkContext.setLogLevel("FATAL")
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    qs, os_ = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if not pat.search(name):
            continue
        t0 = time.time()
        try:
            a = fn(spark, sf).toPandas()
        except Exception as e:
            bad += 1
            print("ERR ", name, str(e)[:700], flush=True)
            continue
        t1 = time.time()
        if name not in os_:
            print("ROWS", name, len(a), f"{t1 - t0:.1f}s", flush=True)
            continue
        try:
            b = con.execute(os_[name]).df()
        except Exception as e:
            bad += 1
            print("OERR", name, str(e)[:500], flush=True)
            continue
        t2 = time.time()
        (ca, ra), (cb, rb) = canon(a), canon(b)
        ok = ca == cb and ra == rb
        kinds = {c: (a[c].dtype.kind, b[c].dtype.kind) for c in ca if c in b and a[c].dtype.kind != b[c].dtype.kind}
        print("OK  " if ok else "DIFF", name, len(a), len(b), f"{t1 - t0:.1f}s/{t2 - t1:.1f}s", kinds or "", flush=True)
        if len(a) == 0:
            print("   EMPTY", flush=True)
        if not ok:
            bad += 1
            print("   ", ca if ca == cb else (ca, cb))
            only_a = sorted(set(ra) - set(rb))[:2]
            only_b = sorted(set(rb) - set(ra))[:2]
            print("    spark:", only_a, "\n    duck :", only_b, flush=True)
    print("bad", bad)


if __name__ == "__main__":
    main()
