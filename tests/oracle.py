"""Runs a query and its SQL on the driver's tables and compares rows as multisets."""

import glob
import os
from collections import Counter

import duckdb

DATA = "/root/testdata/sf0.001"
there = os.path.isdir(DATA)


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0 if v == v else None
    return v if v is None or isinstance(v, (int, str, bool)) else str(v)


def compare(spark, query, sql):
    db = duckdb.connect()
    db.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got = query(spark, DATA)
    names = sorted(got.columns)
    cursor = db.execute(sql)
    columns = [d[0] for d in cursor.description]
    want = Counter(tuple(plain(row[columns.index(n)]) for n in names) for row in cursor.fetchall())
    assert sorted(columns) == names
    assert Counter(tuple(plain(r[n]) for n in names) for r in got.collect()) == want
