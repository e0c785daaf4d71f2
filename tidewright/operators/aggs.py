"""Aggregate expressions with the funnel's null rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def distinct_if(value: Column | str, condition: Column) -> Column:
    """Distinct non-null values of the rows that satisfy the condition."""
    return F.count_distinct(F.when(condition, _c(value)))


def total(value: Column | str) -> Column:
    """The sum, 0 over no rows."""
    return F.coalesce(F.sum(_c(value)), F.lit(0))


def sum_if(value: Column | str, condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, _c(value))), F.lit(0))


def ratio(part: Column | str, whole: Column | str, otherwise: float | None = 0.0) -> Column:
    """``part / whole`` where the whole is positive, else ``otherwise``."""
    return F.when(_c(whole) > 0, _c(part).cast("double") / _c(whole)).otherwise(F.lit(otherwise).cast("double"))


def has_label(labels: Column | str, *wanted: str) -> Column:
    """Whether any of the labels is there; a null array has none."""
    found = [F.array_contains(_c(labels), w) for w in wanted]
    any_ = found[0]
    for f in found[1:]:
        any_ = any_ | f
    return F.coalesce(any_, F.lit(False))


def known(value: Column | str) -> Column:
    """Neither null nor empty."""
    return _c(value).isNotNull() & (_c(value) != "")


def filled(value: Column | str) -> Column:
    """Trimmed, with blank as null."""
    return F.nullif(F.trim(_c(value)), F.lit(""))


def flag(value: Column | str) -> Column:
    """A three-valued flag with null as false."""
    return F.coalesce(_c(value), F.lit(False))


def gate(failed: Column, warned: Column) -> Column:
    """1 if anything failed, else 2 if anything warned, else 0."""
    return F.when(F.sum(failed.cast("int")) > 0, 1).when(F.sum(warned.cast("int")) > 0, 2).otherwise(0)
