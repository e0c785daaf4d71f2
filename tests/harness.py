"""Run a query in Spark and its SQL in DuckDB, and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import math
import os
from collections import Counter

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def plain(x):
    """A value as both engines mean it."""
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, decimal.Decimal):
        return round(float(x), 6)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in sorted(x.items()))
    return x


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return c


def differences(spark, query, sql: str, sf_dir: str) -> list[str]:
    """What differs, or nothing."""
    df = query(spark, sf_dir)
    result = duck(sf_dir).execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    order = sorted(names)
    left = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    right = Counter(tuple(plain(dict(zip(names, row, strict=True))[c]) for c in order) for row in result.fetchall())
    out = [f"spark only: {dict(zip(order, r))}" for r in list(left - right)[:3]]
    out += [f"duckdb only: {dict(zip(order, r))}" for r in list(right - left)[:3]]
    return out
