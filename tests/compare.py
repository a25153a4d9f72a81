"""Compares a query with its SQL on the same tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def by_spark(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(map(plain, r)) for r in df.select(*cols).collect())


def by_sql(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    rel = con.sql(sql)
    names = list(rel.columns)
    cols = sorted(names)
    return cols, sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall())
