"""Comparing a query with its SQL on the same tables."""

import decimal
import glob
import math
import os
from collections import Counter

import duckdb

DATA = os.environ.get("MILLRACE_TESTDATA", "/root/testdata/sf0.001")
MISSING = not os.path.isdir(DATA)


def connect():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def assert_same(spark, con, query, sql):
    df = query(spark, DATA)
    result = con.sql(sql)
    assert sorted(df.columns) == sorted(result.columns)
    order = sorted(df.columns)
    got = Counter(repr(tuple(plain(r[c]) for c in order)) for r in df.collect())
    at = [result.columns.index(c) for c in order]
    want = Counter(repr(tuple(plain(r[i]) for i in at)) for r in result.fetchall())
    assert got == want
