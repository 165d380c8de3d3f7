"""Rows of a query and of its SQL, made comparable."""

from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, list | tuple):
        return tuple(norm(x) for x in v)
    return v


def rows_of(df):
    cols = sorted(df.columns)
    return Counter(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect()), cols


def rows_of_sql(sql: str, sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    rel = con.sql(sql)
    cols = rel.columns
    at = [cols.index(c) for c in sorted(cols)]
    return Counter(repr(tuple(norm(r[i]) for i in at)) for r in rel.fetchall()), sorted(cols)


def assert_same(df, sql: str, sf: str):
    got, cols = rows_of(df)
    want, names = rows_of_sql(sql, sf)
    assert cols == names
    assert got == want
