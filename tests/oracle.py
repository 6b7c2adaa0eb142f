"""Compare a query with its DuckDB SQL as multisets of rows, columns by name."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if hasattr(v, "__len__") and not isinstance(v, str):
        return tuple(norm(x) for x in v)
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return None
    return v.item() if hasattr(v, "item") else v


def rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(norm(v) for v in r) for r in df[cols].itertuples(index=False)), key=repr)


def expected(sql, sf_dir=None, **frames):
    con = duckdb.connect()
    for t in TABLES if sf_dir else ():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, frame in frames.items():
        con.register(name, frame)
    return con.execute(sql).df()
