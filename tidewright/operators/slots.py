"""Bookable times: zone-aware filters and an even choice within a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least distance of chosen slots in minutes; days shown and slots a day; Friday's last hour.
GAP_MINUTES, DAYS, PER_DAY, FRIDAY_CUTOFF = 45, 3, 4, 14


def spread(times: Column, count: int = PER_DAY, gap_minutes: int = GAP_MINUTES) -> Column:
    """At most ``count`` of sorted times: whole and half hours if there are any, and, if still too many, greedily apart."""
    clean = F.filter(times, lambda t: F.minute(t).isin(0, 30))
    pool = F.when(F.size(clean) > 0, clean).otherwise(times)
    far = lambda picked, t: F.unix_micros(t.cast("timestamp")) - F.unix_micros(F.element_at(picked, -1).cast("timestamp")) >= gap_minutes * 60_000_000
    take = lambda picked, t: F.when((F.size(picked) < count) & far(picked, t), F.array_append(picked, t)).otherwise(picked)
    picked = F.aggregate(F.slice(pool, F.lit(2), F.greatest(F.size(pool) - 1, F.lit(0))), F.slice(pool, 1, 1), take)
    return F.when(F.size(pool) <= count, pool).otherwise(picked)


def availability(slots: DataFrame, person: str, at: str, filter_zone: Column, show_zone: Column, start_hour: Column, end_hour: Column, days: int = DAYS, per_day: int = PER_DAY, friday_cutoff: int = FRIDAY_CUTOFF) -> DataFrame:
    """(person, day, times): a person's next days with chosen times, in the zone of display.

    Weekends and hours are judged in the filter zone, Friday's cutoff and the
    grouping by day in the zone of display. ``at`` is a time in UTC.
    """
    utc = F.col(at).cast("timestamp")
    own, shown = F.from_utc_timestamp(utc, filter_zone), F.from_utc_timestamp(utc, show_zone)
    open_ = F.dayofweek(own).between(2, 6) & (F.hour(own) >= start_hour) & (F.hour(own) < end_hour)
    late = (F.dayofweek(shown) == 6) & (F.hour(shown) >= friday_cutoff)
    kept = slots.filter(open_ & ~late).select(person, F.to_date(shown).alias("day"), shown.cast("timestamp_ntz").alias("time"))
    daily = kept.groupBy(person, "day").agg(F.array_sort(F.collect_list("time")).alias("times"))
    ranked = daily.withColumn("n", F.row_number().over(Window.partitionBy(person).orderBy("day"))).filter(F.col("n") <= days)
    return ranked.select(person, "day", spread(F.col("times"), per_day).alias("times"))
