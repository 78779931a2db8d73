"""Rows of a query and of its SQL, as multisets."""

import os
from collections import Counter

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(plain, v))
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
        return None
    return v.item() if isinstance(v, np.generic) else v


def rows(frame, columns):
    return Counter(tuple(map(plain, r)) for r in frame[columns].astype(object).itertuples(index=False))


def connect(folder):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        f = f"{folder}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{f + '/*.parquet' if os.path.isdir(f) else f}'")
    return c


def assert_same(spark, folder, query, sql):
    a, b = query(spark, folder).toPandas(), connect(folder).sql(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a, sorted(a.columns)) == rows(b, sorted(a.columns))
