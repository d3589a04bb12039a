"""Runs a query in Spark and its SQL in DuckDB and compares rows, columns sorted by name."""

import glob
import math
import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def rows(cols, names, data):
    at = [names.index(c) for c in cols]
    return sorted(repr([plain(r[i]) for i in at]) for r in data)


def same(spark, con, query, sql, folder):
    df = query(spark, folder)
    cols = sorted(df.columns)
    want = con.execute(sql)
    names = [x[0] for x in want.description]
    assert sorted(names) == cols
    assert rows(cols, df.columns, df.collect()) == rows(cols, names, want.fetchall())
