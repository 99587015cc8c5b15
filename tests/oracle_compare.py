"""Run registered queries in Spark and their SQL in DuckDB and compare results.

Usage: python tests/oracle_compare.py [data_dir] [key ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(data_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA:
        return None
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float) and math.isnan(v):
        return None
    return v


def rows_of(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    out = [tuple(_norm(v) for v in row) for row in df[cols].itertuples(index=False, name=None)]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def text_rows(df: pd.DataFrame) -> list[tuple]:
    """Rows as the text of each cell (columns by name), the way a text hash sees them."""
    cols = sorted(df.columns)
    # Whole numbers with nulls come as floats or as Int64, depending on the engine.
    gaps = {c: "float64" for c in cols if df[c].isna().any() and pd.api.types.is_numeric_dtype(df[c])}
    return sorted(tuple(str(v) for v in row) for row in df[cols].astype(gaps).astype(str).itertuples(index=False, name=None))


def compare(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame) -> tuple[bool, str]:
    if sorted(spark_pdf.columns) != sorted(duck_pdf.columns):
        return False, f"columns differ: {sorted(spark_pdf.columns)} vs {sorted(duck_pdf.columns)}"
    if len(spark_pdf) != len(duck_pdf):
        return False, f"row counts differ: {len(spark_pdf)} vs {len(duck_pdf)}"
    a, b = rows_of(spark_pdf), rows_of(duck_pdf)
    for x, y in zip(a, b):
        if x != y:
            return False, f"first differing row:\n  spark {x}\n  duck  {y}"
    ta, tb = text_rows(spark_pdf), text_rows(duck_pdf)
    for x, y in zip(ta, tb):
        if x != y:
            return False, f"same values, different text:\n  spark {x}\n  duck  {y}"
    return True, "ok"


def main(argv: list[str]) -> int:
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as E
    from tillroll.session import build_session

    data_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:] or list(E.queries())
    spark = build_session("local[8]", 8)
    con = duck(data_dir)
    qs, sql = E.queries(), E.oracle_sql()
    bad = 0
    for k in keys:
        t = time.time()
        try:
            s = qs[k](spark, data_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {k}: spark error {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t
        if k not in sql:
            print(f"ROWS {k}: {len(s)} rows (no oracle) {ts:.2f}s")
            continue
        try:
            o = con.sql(sql[k]).df()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {k}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        ok, msg = compare(s, o)
        print(f"{'OK  ' if ok else 'FAIL'} {k}: {len(s)} rows {ts:.2f}s {'' if ok else msg}")
        bad += 0 if ok else 1
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
