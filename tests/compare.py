"""Compares a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import decimal
import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if hasattr(value, "isoformat"):
        return value.isoformat()[:26].replace("T", " ")
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    return value


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def both(spark, query, sql: str, sf_dir: str, con=None) -> tuple[Counter, Counter, list[str], list[str]]:
    frame = query(spark, sf_dir)
    names = sorted(frame.columns)
    ours = Counter(tuple(plain(r[c]) for c in names) for r in frame.collect())
    got = (con or database(sf_dir)).execute(sql)
    cols = [d[0] for d in got.description]
    order = [cols.index(c) for c in sorted(cols)]
    theirs = Counter(tuple(plain(r[i]) for i in order) for r in got.fetchall())
    return ours, theirs, names, sorted(cols)
