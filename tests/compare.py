"""Spark rows against DuckDB rows."""

import math
import os

import duckdb


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return repr(x + 0.0) if isinstance(x, float) else repr(x)


def connection(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
    return con


def assert_same(df, con, sql):
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted(str([plain(row[names.index(c)]) for c in order]) for row in found.fetchall())
    got = sorted(str([plain(row[c]) for c in order]) for row in df.collect())
    assert got == want
