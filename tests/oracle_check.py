"""Run every registered query in Spark and its oracle SQL in DuckDB, compare.

    python tests/oracle_check.py [sf_dir] [name ...]

Comparison: same column names, same row count, and the same multiset of rows
(order-insensitive); doubles must agree to 1e-9 relative, and exact bit
equality is reported separately.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"create view {t} as select * from read_parquet('{path}')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return ("nan",)
        return ("f", v)
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return ("v", v)


def _key(row):
    return tuple((t[0], str(t[1:])) for t in row)


def compare(spark_rows, spark_cols, duck_rows, duck_cols):
    if sorted(spark_cols) != sorted(duck_cols):
        return False, f"columns differ: {sorted(spark_cols)} vs {sorted(duck_cols)}", False
    order = sorted(spark_cols)
    si = [spark_cols.index(c) for c in order]
    di = [duck_cols.index(c) for c in order]
    a = sorted((tuple(_norm(r[i]) for i in si) for r in spark_rows), key=_key)
    b = sorted((tuple(_norm(r[i]) for i in di) for r in duck_rows), key=_key)
    if len(a) != len(b):
        return False, f"row count {len(a)} vs {len(b)}", False
    exact = a == b
    if exact:
        return True, f"{len(a)} rows, exact", True
    for ra, rb in zip(a, b):
        for (x, y, c) in zip(ra, rb, order):
            if x == y:
                continue
            if x[0] == "f" and y[0] == "f" and math.isclose(x[1], y[1], rel_tol=1e-9, abs_tol=1e-12):
                continue
            return False, f"value differs in {c}: {x} vs {y}\n  spark {ra}\n  duck  {rb}", False
    return True, f"{len(a)} rows, close (not bit-exact)", False


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    import __spark_entry__ as E
    from flowsentry.session import build_session
    spark = build_session()
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in (names or list(qs)):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            cols = df.columns
            rows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in sqls:
            print(f"---- {name}: {len(rows)} rows (no oracle) {ts:.2f}s")
            continue
        try:
            cur = con.execute(sqls[name])
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        ok, msg, exact = compare(rows, cols, drows, dcols)
        print(f"{'ok  ' if ok else 'FAIL'} {name}: {msg} ({ts:.2f}s)")
        bad += 0 if ok else 1
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
