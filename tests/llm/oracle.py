"""Runs a query's SQL in DuckDB over the tables of a folder."""

import duckdb
import pandas as pd

TABLES = "documents embeddings pages benchmark labels conversations events".split()


def sql(text, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con.execute(text).df()


def same(df, text, sf):
    a, b = df.toPandas(), sql(text, sf)
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    rows = lambda x: sorted(tuple("null" if pd.isna(v) else round(float(v), 9) if isinstance(v, float) else str(v) for v in r) for r in x[cols].itertuples(index=False))
    assert rows(a) == rows(b)
