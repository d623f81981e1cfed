"""Comparison of a query's rows with those of its SQL."""

from __future__ import annotations

import math
import os

import duckdb

#: The smallest tables.
SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "asDict"):
        return value(v.asDict())
    if isinstance(v, dict):
        return tuple((k, value(x)) for k, x in v.items())
    if isinstance(v, (list, tuple)):
        return tuple(value(x) for x in v)
    return bytes(v) if isinstance(v, bytearray) else v


def sql_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    found = con.sql(sql)
    return found.columns, found.fetchall()


def assert_same(df, sql: str, sf_dir: str) -> None:
    columns, rows = sql_rows(sql, sf_dir)
    names = sorted(df.columns)
    assert sorted(columns) == names
    at = [columns.index(c) for c in names]
    expected = sorted(repr(tuple(value(r[i]) for i in at)) for r in rows)
    found = sorted(repr(tuple(value(r[c]) for c in names)) for r in df.collect())
    assert found == expected
