"""Compares registered queries with their SQL on DuckDB."""

import datetime
import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v.isoformat() if isinstance(v, datetime.datetime) else v


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def check(spark, sf, query, sql):
    df = query(spark, sf)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    found = connect(sf).execute(sql)
    theirs = [d[0] for d in found.description]
    assert sorted(theirs) == names
    want = sorted((tuple(plain(r[theirs.index(c)]) for c in names) for r in found.fetchall()), key=repr)
    assert got == want and got
