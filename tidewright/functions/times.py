"""Dates, months, zones and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed_date(value: Column) -> Column:
    """A date written ``yyyy-MM-dd`` or ``yyyyMMdd``, else null."""
    return F.coalesce(F.try_to_timestamp(value, F.lit("yyyy-MM-dd")), F.try_to_timestamp(value, F.lit("yyyyMMdd"))).cast("date")


def months_apart(later: Column, earlier: Column) -> Column:
    """The difference of calendar months; days don't count."""
    return (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)


def iso_time(value: Column) -> Column:
    """Epoch seconds as an ISO time in UTC; blank as null; any other text as it is."""
    seconds = value.try_cast("double")
    shown = F.date_format(F.timestamp_seconds(F.floor(seconds)), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return F.when(F.trim(value) == "", F.lit(None)).when(seconds.isNotNull(), shown).otherwise(value)


def years_before(day: Column, n: int) -> Column:
    """The same day ``n`` years before; 29 February becomes the 28th."""
    return F.add_months(day, -12 * n)


def window_start(day: Column, months: int, offset: int = 0) -> Column:
    """struct(start, end): ``months`` calendar months that end ``offset`` months before ``day``."""
    end = F.add_months(day, -offset)
    return F.struct(F.add_months(end, -months).alias("start"), end.alias("end"))


def number(value: Column) -> Column:
    """A number, with anything else as 0."""
    n = value.try_cast("double")
    return F.when(n.isNull() | F.isnan(n), F.lit(0.0)).otherwise(n)


def thousands(value: Column) -> Column:
    """Grouped digits, a dash for null."""
    return F.coalesce(F.format_number(value, 0), F.lit("—"))


def percent(value: Column, digits: int = 1) -> Column:
    return F.when(value.isNull(), F.lit("—")).otherwise(F.concat(F.format_number(value * 100, digits), F.lit("%")))
