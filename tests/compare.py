"""Runs a query and its SQL twin over the same tables and compares rows as bags."""

import os

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"


def connection(folder=DATA):
    con = duckdb.connect()
    for name in os.listdir(folder):
        path = f"{folder}/{name}"
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def bag(df):
    def value(x):
        if x is None or x is pd.NA or isinstance(x, float) and x != x:
            return None
        return round(float(x), 6) if isinstance(x, float) else x if isinstance(x, str | bool) else float(x)

    return sorted((tuple(value(x) for x in row) for row in df[sorted(df.columns)].itertuples(index=False)), key=str)


def same(spark, query, sql, folder=DATA):
    ours, theirs = query(spark, folder).toPandas(), connection(folder).execute(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert bag(ours) == bag(theirs)
