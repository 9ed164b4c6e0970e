"""Compares a query with its SQL in DuckDB, as sorted rows."""

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)].astype(object).where(lambda x: x.notna(), None)
    plain = lambda v: v.item() if isinstance(v, np.generic) else v
    return sorted((tuple(plain(v) for v in r) for r in pdf.itertuples(index=False)), key=repr)


def assert_same(spark, sf, query, sql, name=""):
    got, want = query(spark, sf).toPandas(), connect(sf).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns), name
    a, b = rows(got), rows(want)
    assert len(a) == len(b), (name, len(a), len(b))
    for x, y in zip(a, b, strict=True):
        assert x == y or all(u == v or (isinstance(u, (int, float)) and isinstance(v, (int, float)) and abs(u - v) < 2e-6) for u, v in zip(x, y, strict=True)), (name, x, y)
