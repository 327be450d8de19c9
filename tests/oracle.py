"""Compares queries with their SQL twins: columns by name, rows in any order, doubles to 9 digits."""

import glob
import os

import duckdb


def connect(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(f).removesuffix(".parquet")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{f}'")
    c.execute("SET TimeZone = 'UTC'")
    return c


def normal(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return str([normal(x) for x in v])
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in values)


def compare(spark, query, sql, sf_dir):
    got = query(spark, sf_dir)
    ours = rows(got.columns, got.collect())
    cursor = connect(sf_dir).execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = rows(names, cursor.fetchall())
    assert sorted(names) == sorted(got.columns), (sorted(names), sorted(got.columns))
    assert len(ours) == len(theirs), (len(ours), len(theirs))
    bad = [(a, b) for a, b in zip(ours, theirs, strict=True) if a != b]
    assert not bad, (len(bad), bad[:3])
    return len(ours)
