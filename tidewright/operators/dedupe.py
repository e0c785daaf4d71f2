"""Keep one row a key, by explicit and total orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RANK = "__rank"


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key under ``order``; give null placement and a last tie key."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(_RANK, F.row_number().over(window)).filter(F.col(_RANK) == 1).drop(_RANK)


def keep_latest(df: DataFrame, keys: Sequence[str], on: str, tie: str) -> DataFrame:
    """The row of the greatest ``on``; nulls come last, ``tie`` decides between equals."""
    return keep_one(df, keys, [F.desc_nulls_last(on), F.asc_nulls_last(tie)])


def keep_first(df: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """The row seen first by an explicit ordinal."""
    return keep_one(df, keys, [F.asc_nulls_last(ordinal)])


def keep_last(df: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """The row seen last by an explicit ordinal."""
    return keep_one(df, keys, [F.desc_nulls_last(ordinal)])


def keep_recent(df: DataFrame, key: str, on: str, ordinal: str) -> DataFrame:
    """The greatest ``on`` of each non-empty key; of equals the one seen first."""
    known = df.filter(F.col(key).isNotNull() & (F.col(key) != ""))
    return keep_one(known, [key], [F.desc_nulls_last(on), F.asc_nulls_last(ordinal)])


def upsert(table: DataFrame, batch: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """``table`` with the batch's rows put in; of a key's rows in the batch the last counts."""
    new = keep_last(batch, keys, ordinal).drop(ordinal)
    return table.join(new.select(*keys), list(keys), "left_anti").unionByName(new.select(*table.columns))


def insert_absent(table: DataFrame, batch: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """The batch's rows whose key the table lacks, once each, the first seen."""
    return keep_first(batch.join(table.select(*keys), list(keys), "left_anti"), keys, ordinal).drop(ordinal)


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that break uniqueness, with their number of rows; empty if the keys are unique."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
