"""Dated snapshot tables: current and earlier states, freshness, new entities."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, on: str = "snapshot_date") -> DataFrame:
    """Rows of the greatest date; a scalar subquery, so partitions can be pruned."""
    return df.filter(F.col(on) == df.agg(F.max(on)).scalar())


def latest_before(df: DataFrame, day, on: str = "snapshot_date") -> DataFrame:
    """Rows of the greatest date before ``day``."""
    earlier = df.filter(F.col(on) < F.lit(day))
    return earlier.filter(F.col(on) == earlier.agg(F.max(on)).scalar())


def first_seen_on(df: DataFrame, day, key: str, on: str = "snapshot_date") -> DataFrame:
    """Rows of ``day`` whose key is in no earlier snapshot."""
    before = df.filter(F.col(on) < F.lit(day)).select(key).distinct()
    return df.filter(F.col(on) == F.lit(day)).join(before, key, "left_anti")


def freshness(sources: Mapping[str, tuple[DataFrame | None, str]]) -> DataFrame:
    """One row: the greatest time of each source and of all; null for a missing source."""
    spark = next(df for df, _ in sources.values() if df is not None).sparkSession
    one = spark.range(1).select()
    for name, (df, on) in sources.items():
        top = F.lit(None).cast("timestamp_ntz") if df is None else df.agg(F.max(on)).scalar()
        one = one.withColumn(name, top)
    return one.withColumn("overall", F.greatest(*sources) if len(sources) > 1 else F.col(next(iter(sources))))


def within(column: str | Column, start: str, end: str) -> Column:
    """Closed window of whole days whose last instant is 23:59:59.999; null is outside."""
    c = F.col(column) if isinstance(column, str) else column
    return c.between(F.lit(f"{start} 00:00:00.000").cast("timestamp_ntz"), F.lit(f"{end} 23:59:59.999").cast("timestamp_ntz"))
