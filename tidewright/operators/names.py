"""Fold spellings of a person's name onto a roster, never merging ambiguous ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.strings import alike_names


def canonicalise(df: DataFrame, name: str, roster: DataFrame, full_name: str, out: str = "canonical") -> DataFrame:
    """``df`` with the roster's spelling of each name.

    In this order: the full name itself; a first name that one entry has; a
    surname with a first name alike that one entry has; else the name as it is.
    """
    entries = roster.select(F.trim(full_name).alias("_full")).distinct()
    first = F.lower(F.split_part("_full", F.lit(" "), F.lit(1)))
    last = F.lower(F.element_at(F.split("_full", r"\s+"), -1))
    exact = entries.groupBy(F.lower("_full").alias("_low")).agg(F.min("_full").alias("_exact"))
    by_first = entries.groupBy(first.alias("_first")).agg(F.count(F.lit(1)).alias("_n"), F.min("_full").alias("_by_first")).filter("_n = 1").drop("_n")
    by_last = entries.filter(F.size(F.split("_full", r"\s+")) > 1).select(last.alias("_last"), first.alias("_entry_first"), "_full")

    names = df.select(name).filter(F.trim(name) != "").distinct().withColumn("_low", F.lower(F.trim(name)))
    parts = F.split("_low", r"\s+")
    names = names.withColumn("_one", F.size(parts) == 1).withColumn("_start", parts[0]).withColumn("_last", F.element_at(parts, -1))
    near = names.filter(~F.col("_one")).join(by_last, "_last").filter(alike_names(F.col("_start"), F.col("_entry_first")))
    near = near.groupBy(name).agg(F.count_distinct("_full").alias("_n"), F.min("_full").alias("_near")).filter("_n = 1").drop("_n")
    found = (
        names.join(exact, "_low", "left")
        .join(by_first, F.col("_one") & (F.col("_start") == F.col("_first")), "left")
        .join(near, name, "left")
        .select(F.col(name).alias("_name"), F.coalesce("_exact", "_by_first", "_near", F.trim(name)).alias(out))
    )
    return df.join(found, F.col(name) == F.col("_name"), "left").withColumn(out, F.coalesce(out, F.col(name))).drop("_name")
