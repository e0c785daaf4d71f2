"""Named queries with their SQL, filled by the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.sources.funnel import Funnel, duck_tables

#: Decimal places at which a query's figures are compared with its SQL; the views themselves don't round.
PLACES = {"closed_won_revenue": 2, "closed_won_amount": 2, "won_amount": 2, "revenue": 2, "close_rate": 6, "ratio": 6, "pos_rate": 6, "reply_rate": 6, "meeting_to_positive": 6}


def comparable(df: DataFrame) -> DataFrame:
    """``df`` with its sums and rates at ``PLACES``."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.round(c, n) for c, n in PLACES.items() if kinds.get(c) == "double"})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, tables: tuple[str, ...] = (), ctes: str = ""):
    """Register ``fn(funnel) -> DataFrame`` as a query.

    ``sql`` is its DuckDB SELECT over the derived ``tables`` and further
    ``ctes``; None where SQL can't express it.
    """

    def add(fn: Callable[[Funnel], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"two queries are called {name}")
        QUERIES[name] = lambda spark, sf_dir: comparable(fn(Funnel(spark, sf_dir)))
        if sql is not None:
            parts = [p for p in (duck_tables(*tables) if tables else "", ctes.strip().rstrip(",")) if p]
            ORACLE_SQL[name] = (f"WITH {', '.join(parts)} " if parts else "") + sql
        return fn

    return add
