"""Rows of a query and of its SQL, in a form that compares."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(sf_dir: str = SF):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return "<null>" if v is None else v


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted((tuple(map(plain, r)) for r in df.select(*(f"`{n}`" for n in names)).collect()), key=repr)


def rows_of_sql(connection, sql):
    r = connection.execute(sql)
    names = [d[0] for d in r.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted((tuple(plain(x[i]) for i in order) for x in r.fetchall()), key=repr)
