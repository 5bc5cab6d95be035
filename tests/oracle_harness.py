"""Run a registered query in Spark and its oracle SQL in DuckDB; compare.

Comparison: same column names, same row count, and the same multiset of rows
with floats compared to a relative tolerance of 1e-9 (and an exact pass when
values are bit-identical).
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def duck(sql: str, sf_dir: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con.sql(sql).df()


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (0, "")
        return (1, v)
    if hasattr(v, "item"):
        v = v.item()
        return _norm(v)
    if isinstance(v, (bool,)):
        return (2, int(v))
    if isinstance(v, int):
        return (1, float(v))
    if isinstance(v, (list, tuple)):
        return (3, tuple(_norm(x) for x in v))
    return (4, str(v))


def rows(pdf: pd.DataFrame):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(None if (not isinstance(x, (list, tuple)) and pd.isna(x) is True) else x)
                         for x in rec))
    out.sort(key=lambda r: tuple((t, str(v)) if t != 1 else (t, f"{v:.6e}") for t, v in r))
    return cols, out


def close(a, b) -> bool:
    if a[0] != b[0]:
        return False
    if a[0] == 1:
        x, y = a[1], b[1]
        return x == y or abs(x - y) <= 1e-9 * max(1.0, abs(x), abs(y))
    return a == b


def compare(spark_pdf: pd.DataFrame, oracle_pdf: pd.DataFrame) -> tuple[bool, str]:
    sc, sr = rows(spark_pdf)
    oc, orr = rows(oracle_pdf)
    if sc != oc:
        return False, f"columns differ: spark={sc} oracle={oc}"
    if len(sr) != len(orr):
        return False, f"row count spark={len(sr)} oracle={len(orr)}"
    # match by sorting on non-float fields first, then floats within tolerance
    bad = 0
    first = None
    for a, b in zip(sr, orr):
        if not all(close(x, y) for x, y in zip(a, b)):
            bad += 1
            if first is None:
                first = (a, b)
    if bad:
        return False, f"{bad} rows differ; first spark={first[0]} oracle={first[1]}"
    return True, f"{len(sr)} rows"


def check(spark, name: str, sf_dir: str) -> tuple[bool, str]:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    q = entry.queries()[name]
    sql = entry.oracle_sql().get(name)
    t = time.time()
    spdf = q(spark, sf_dir).toPandas()
    ts = time.time() - t
    if sql is None:
        return True, f"rows-only {len(spdf)} rows ({ts:.1f}s)"
    opdf = duck(sql, sf_dir)
    ok, msg = compare(spdf, opdf)
    return ok, f"{msg} ({ts:.1f}s)"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from facsimile.session import build_session
    import __spark_entry__ as entry
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = build_session("local[8]", 8)
    fails = 0
    for n in names:
        try:
            ok, msg = check(spark, n, sf)
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"ERROR {type(e).__name__}: {str(e)[:400]}"
        fails += not ok
        print(("PASS " if ok else "FAIL ") + n + ": " + msg, flush=True)
    print(f"{fails} failures of {len(names)}")
