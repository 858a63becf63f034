"""DuckDB beside Spark: the same tables, the same rows."""

import collections
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


def compare(spark, con, f, sql, sf_dir):
    df = f(spark, sf_dir)
    cols = sorted(df.columns)
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    got = collections.Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    want = collections.Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    assert got == want
