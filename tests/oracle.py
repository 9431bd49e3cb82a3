"""Holds queries against their SQL in DuckDB."""

import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql(text, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con.execute(text).df()


def cell(v):
    if v is None or (not isinstance(v, (list, tuple)) and pd.isna(v)):
        return "null"
    if isinstance(v, float):
        return f"{0.0 if math.isclose(v, 0) else v:.6f}"
    if isinstance(v, bool):
        return str(v)
    try:
        return f"{float(v):.6f}"
    except (TypeError, ValueError):
        return str(v)


def differences(df, text, sf):
    a, b = df.toPandas(), sql(text, sf)
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} and {sorted(b.columns)}"
    cols = sorted(a.columns)
    rows = lambda x: sorted(tuple(cell(v) for v in r) for r in x[cols].itertuples(index=False))
    x, y = rows(a), rows(b)
    if x == y:
        return ""
    return f"{len(x)} and {len(y)} rows; {cols}; only here {sorted(set(x) - set(y))[:3]}; only in SQL {sorted(set(y) - set(x))[:3]}"
