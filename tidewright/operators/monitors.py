"""Threshold decisions and event filters over campaign and sheet rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.times import number

# The limits of the campaign monitor.
MAX_WITHOUT_POSITIVE, MIN_FOR_RATE, MIN_RATE_PERCENT, MAX_AWAY_PERCENT = 2000, 500, 0.5, 20.0
LOOK_BACK_DAYS = 1095


def decide(df: DataFrame) -> DataFrame:
    """Campaign rows with ``decision``, ``reason`` and ``checked``.

    Needs status, lead_count, completed, contacted, replied, positive and the
    counts ``away`` of ``lead_total``. Rows that are skipped aren't checked.
    """
    n = {c: number(F.col(c).cast("string")) for c in ("lead_count", "completed", "contacted", "replied", "positive", "away", "lead_total")}
    rate = F.when(n["contacted"] > 0, n["replied"] / n["contacted"] * 100).otherwise(0.0)
    away = F.when(n["lead_total"] > 0, n["away"] / n["lead_total"] * 100).otherwise(0.0)
    inactive = F.upper(F.coalesce("status", F.lit(""))) != "ACTIVE"
    complete = (n["lead_count"] > 0) & ((n["completed"] >= n["lead_count"]) | (n["contacted"] >= n["lead_count"]))
    say = lambda decision, reason: F.struct(F.lit(decision).alias("decision"), F.lit(reason).alias("reason"))
    verdict = (
        F.when(inactive, say("skip", "inactive"))
        .when(complete, say("skip", "complete"))
        .when(away > MAX_AWAY_PERCENT, say("skip", "away"))
        .when(n["positive"] >= 1, say("ok", "positive"))
        .when(n["contacted"] >= MAX_WITHOUT_POSITIVE, say("pause", "no positive"))
        .when((n["contacted"] >= MIN_FOR_RATE) & (rate < MIN_RATE_PERCENT), say("pause", "low rate"))
        .otherwise(say("ok", "rate"))
    )
    return df.withColumn("v", verdict).select(*df.columns, "v.decision", "v.reason", (F.col("v.decision") != "skip").alias("checked"))


def oldest_day(days: Column, today: Column, look_back: int = LOOK_BACK_DAYS) -> Column:
    """Aggregate: the oldest valid day, not after today; without one, ``look_back`` days before."""
    d = F.try_to_timestamp(days).cast("date")
    return F.coalesce(F.least(F.min(d), F.first(today)), F.first(F.date_sub(today, look_back)))


def edits(events: DataFrame, sheet: str, column: int, header_rows: int, value: str) -> DataFrame:
    """Sheet edits that set a column of the sheet to a value; works on streams too. Repeats stay."""
    hit = (F.col("sheet") == sheet) & (F.col("col") == column) & (F.col("row") > header_rows) & (F.trim("value") == value)
    return events.filter(hit).select("row", "name", "email", "domain", "date")


def survivors(sources: Mapping[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, dict[str, str]]:
    """The union of the sources that can be planned, and what failed in the others."""
    from pyspark.errors import PySparkException

    out, failed = None, {}
    for name, load in sources.items():
        try:
            rows = load().withColumn("source", F.lit(name))
        except PySparkException as error:
            failed[name] = str(error).splitlines()[0]
            continue
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out, failed


def outcome(load: Callable[[], DataFrame]) -> tuple[str, DataFrame | None, str]:
    """(``data``, rows, '') or (``missing``, None, why) for a table that isn't there, or (``error``, None, why)."""
    from pyspark.errors import AnalysisException, PySparkException

    try:
        return "data", load(), ""
    except AnalysisException as error:
        kind = "missing" if error.getCondition() in ("TABLE_OR_VIEW_NOT_FOUND", "PATH_NOT_FOUND") else "error"
        return kind, None, str(error).splitlines()[0]
    except PySparkException as error:
        return "error", None, str(error).splitlines()[0]


def outcomes(spark: SparkSession, loads: Mapping[str, Callable[[], DataFrame]]) -> DataFrame:
    """(source, kind, rows): the outcome of each load and how many rows it has, null without data."""
    found = []
    for name, load in loads.items():
        kind, rows, _ = outcome(load)
        found.append((name, kind, rows.count() if rows is not None else None))
    return spark.createDataFrame(found, "source string, kind string, rows long")


def machine_share(written: Column | str, assisted: Column | str) -> Column:
    """What a detector counts as written by a machine: its own share and the assisted one, null as none."""
    share = lambda c: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0.0))
    return share(written) + share(assisted)
