"""Run registered Spark queries next to their DuckDB oracle and compare.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Rows are compared order-insensitively after sorting columns by name;
doubles are compared with a 1e-6 tolerance.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from lexalign.sources.tables import TABLES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v


def _key(row):
    return tuple((0, "") if v is None else (1, str(v)) for v in row)


def compare(spark_rows, spark_cols, duck_rows, duck_cols, tol=1e-6):
    if sorted(spark_cols) != sorted(duck_cols):
        return False, f"columns differ: {sorted(spark_cols)} vs {sorted(duck_cols)}"
    order = sorted(spark_cols)
    si = [spark_cols.index(c) for c in order]
    di = [duck_cols.index(c) for c in order]
    a = sorted((tuple(r[i] for i in si) for r in spark_rows), key=lambda r: _key(map(_norm, r)))
    b = sorted((tuple(r[i] for i in di) for r in duck_rows), key=lambda r: _key(map(_norm, r)))
    if len(a) != len(b):
        return False, f"row count {len(a)} vs {len(b)}"
    bad = 0
    first = None
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            if isinstance(u, float) or isinstance(v, float):
                if u is None or v is None:
                    ok = u is None and v is None
                else:
                    ok = abs(float(u) - float(v)) <= tol * max(1.0, abs(float(v)))
            else:
                ok = u == v
            if not ok:
                bad += 1
                first = first or (x, y)
                break
    return bad == 0, (f"{bad} rows differ, first {first}" if bad else "ok")


def main(argv):
    sf = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    import __spark_entry__ as E
    from lexalign.session import get_session

    spark = get_session()
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf)
    failures = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            rows = [tuple(r) for r in df.collect()]
            cols = df.columns
        except Exception as ex:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(ex).__name__}: {str(ex)[:400]}")
            failures += 1
            continue
        ts = time.time() - t0
        if name not in sqls:
            print(f"ROWS {name}: {len(rows)} rows ({ts:.1f}s) {rows[:2]}")
            continue
        res = con.sql(sqls[name])
        ok, msg = compare(rows, cols, res.fetchall(), res.columns)
        failures += 0 if ok else 1
        print(f"{'PASS' if ok else 'FAIL'} {name}: {len(rows)} rows ({ts:.1f}s) {msg}")
    print("failures:", failures)
    return failures


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
