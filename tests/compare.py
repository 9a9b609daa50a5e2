"""Rows of Spark and of DuckDB in a form that can be compared."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb


def cell(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    if isinstance(x, list):
        return tuple(map(cell, x))
    return x


def key(row):
    return tuple((x is None, str(x)) for x in row)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(cell(r[n]) for n in names) for r in df.collect()), key=key)


def duck_rows(sql, sf_dir):
    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from read_parquet('{p}{'/*' if p.is_dir() else ''}')")
    out = c.sql(sql)
    names = sorted(out.columns)
    at = [out.columns.index(n) for n in names]
    return names, sorted((tuple(cell(r[k]) for k in at) for r in out.fetchall()), key=key)


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6)
    return a == b


def same(df, sql, sf_dir):
    (n1, r1), (n2, r2) = spark_rows(df), duck_rows(sql, sf_dir)
    assert n1 == n2
    assert len(r1) == len(r2)
    wrong = [(x, y) for x, y in zip(r1, r2, strict=True) if not all(map(close, x, y))]
    assert not wrong, (len(wrong), wrong[:3])
