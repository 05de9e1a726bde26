"""Local stand-in for the driver's correctness gate.

Runs each registered Spark query and its DuckDB oracle on the same Parquet
tables and compares row count, column names and an order-insensitive hash of
the values.  Usage: ``python tests/oracle_check.py [sf_dir] [name ...]``.
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402


def _norm(v):
    if v is None:
        return "None"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6) + 0.0)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{_norm(k)}:{_norm(x)}" for k, x in sorted(v.items(), key=lambda t: str(t[0]))) + "}"
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16], lines


def _kind(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "int"
    if isinstance(v, float):
        return "float"
    return type(v).__name__


def column_type_diff(scols, srows, dcols, drows):
    """Columns whose Python value types differ between the engines (e.g. Decimal vs float)."""
    out = {}
    for c in scols:
        if c not in dcols:
            continue
        i, j = scols.index(c), dcols.index(c)
        ks = {_kind(r[i]) for r in srows} - {None}
        kd = {_kind(r[j]) for r in drows} - {None}
        if ks and kd and ks != kd:
            out[c] = (sorted(ks), sorted(kd))
    return out


def duck(sf_dir: str):
    from prefspark.sources.tables import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    import __spark_entry__ as E
    from prefspark.session import build_session

    spark = build_session()
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in names or sorted(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in sqls:
            print(f"rows-only {name}: {len(srows)} rows ({ts:.1f}s)")
            continue
        try:
            cur = con.execute(sqls[name])
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        hs, ls = digest(scols, srows)
        hd, ld = digest(dcols, drows)
        type_diff = column_type_diff(scols, srows, dcols, drows)
        ok = len(srows) == len(drows) and sorted(scols) == sorted(dcols) and hs == hd and not type_diff
        print(f"{'ok  ' if ok else 'FAIL'} {name}: spark {len(srows)} rows, duck {len(drows)} rows ({ts:.1f}s)")
        if not ok:
            bad += 1
            if sorted(scols) != sorted(dcols):
                print("   cols", sorted(scols), sorted(dcols))
            if type_diff:
                print("   value types differ", type_diff)
            diff_s = sorted(set(ls) - set(ld))[:5]
            diff_d = sorted(set(ld) - set(ls))[:5]
            print("   spark-only", diff_s)
            print("   duck-only ", diff_d)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
