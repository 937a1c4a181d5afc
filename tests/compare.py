"""Runs a query and its SQL on the same tables and compares the rows without order."""

import glob
import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if v.__class__.__name__ == "Decimal":
        return float(f"{float(v):.9g}")
    if hasattr(v, "asDict"):
        return plain(v.asDict(recursive=False))
    if isinstance(v, dict):
        return tuple(sorted((str(k), plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "tzinfo") and getattr(v, "tzinfo", None) is not None:
        return v.replace(tzinfo=None)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def assert_same(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    cur = views(sf_dir).execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names), (sorted(df.columns), sorted(names))
    ours, theirs = rows_of(df.columns, df.collect()), rows_of(names, cur.fetchall())
    assert ours == theirs, (list((ours - theirs).items())[:3], list((theirs - ours).items())[:3], sum(ours.values()), sum(theirs.values()))
    return sum(ours.values())
