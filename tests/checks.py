"""Comparing a query with its SQL."""

import math

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return f"{type(v).__name__}:{v}"


def connection(sf=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def assert_same(df, con, sql):
    rel = con.sql(sql)
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    order = [rel.columns.index(c) for c in cols]
    got = sorted(norm(tuple(r)) for r in df.select(cols).collect())
    assert got == sorted(norm(tuple(r[i] for i in order)) for r in rel.fetchall())
