"""Compare a query with its SQL on the same tables."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        kind = df[c].dtype.kind
        if kind in "iub" or (kind == "O" and df[c].map(lambda x: isinstance(x, (int, bool))).any()):
            df[c] = df[c].map(lambda x: "" if x is None or x != x else str(int(x)))
        elif kind == "f":
            df[c] = df[c].map(lambda x: "" if x != x else str(int(x)) if float(x).is_integer() else f"{x:.9g}")
        else:
            df[c] = df[c].map(lambda x: "" if x is None or x is pd.NaT or x != x else str(x))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def difference(spark_df, con, sql):
    """None if equal, else a short account."""
    a, b = plain(spark_df.toPandas()), plain(con.sql(sql).df())
    if list(a.columns) != list(b.columns):
        return f"columns {list(a.columns)} and {list(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} and {len(b)}"
    bad = (a != b).any(axis=1)
    return f"{int(bad.sum())} of {len(a)} rows differ, e.g.\n{a[bad].head(3)}\n{b[bad].head(3)}" if bad.any() else None
