"""Runs a query's SQL in DuckDB over the same files and compares rows without regard to order."""

import glob
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    c = duckdb.connect()
    for t in TABLES:
        files = glob.glob(f"{sf}/{t}.parquet/*.parquet") or [f"{sf}/{t}.parquet"]
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet({files!r})")
    return c


def plain(x):
    if hasattr(x, "item"):
        x = x.item()
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in data]
    return sorted(out, key=lambda r: tuple((x is not None, str(x)) for x in r))


def same(df, sql: str, sf: str) -> None:
    got = connect(sf).sql(sql)
    assert sorted(df.columns) == sorted(got.columns)
    a, b = rows(df.columns, [tuple(r) for r in df.collect()]), rows(got.columns, got.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert len(x) == len(y)
        for p, q in zip(x, y):
            assert p == q or (isinstance(p, float) and isinstance(q, (float, int)) and abs(p - q) <= 1e-6 * max(1, abs(p))), (x, y)
