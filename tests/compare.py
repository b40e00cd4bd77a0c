"""Comparison of a query's rows with its oracle's, as the driver makes it."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con.execute(sql).df()


def text(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, (float, np.floating)) and np.isnan(x)):
        return "NULL"
    if isinstance(x, (np.ndarray, list)):
        return str([text(y) for y in x])
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (int, float, np.integer, np.floating)):
        return repr(round(float(x), 6) + 0.0)
    return str(x)


def rows(df):
    return sorted("|".join(text(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


def same(spark_df, sf, sql):
    mine, theirs = spark_df.toPandas(), oracle(sf, sql)
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)
