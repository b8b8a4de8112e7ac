"""Comparison of a query's rows with those of its SQL in DuckDB."""

import decimal
import math
import os
from collections import Counter

import duckdb


def connect(folder):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(folder):
        path = os.path.join(folder, name)
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def compare(df, c, sql):
    """None if the rows agree, else the names or rows that differ."""
    names = sorted(df.columns)
    found = c.execute(sql)
    theirs = [d[0] for d in found.description]
    if sorted(theirs) != names:
        return names, sorted(theirs)
    want = Counter(tuple(plain(r[theirs.index(n)]) for n in names) for r in found.fetchall())
    have = Counter(tuple(plain(r[n]) for n in names) for r in df.select(*names).collect())
    return None if have == want else (list((have - want).items())[:3], list((want - have).items())[:3])
