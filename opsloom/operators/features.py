"""Row-local features: calendar, interactions, durations, linkage flags. No shuffle in this module."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from opsloom.operators.text import text_stats


# Holidays as month-day, business hours (both ends included), defaults for a missing time.
HOLIDAYS = ("01-01", "01-15", "02-19", "05-27", "06-19", "07-04", "09-02", "10-14", "11-11", "11-28", "12-25")
BUSINESS_FROM, BUSINESS_TO = 8, 18
DEFAULT_HOUR, DEFAULT_WEEKDAY, DEFAULT_MONTH = 12, 0, 1
DEFAULT_PRIORITY, DEFAULT_IMPACT, DEFAULT_URGENCY = 3, 2, 2
# Target transform of the duration model.
TARGET_CAP_HOURS, TARGET_DEFAULT_HOURS, LOG_CAP = 168.0, 4.0, 15.0


def date_parts(df: DataFrame, at: str = "opened_at") -> DataFrame:
    weekday = F.coalesce(F.weekday(at), F.lit(DEFAULT_WEEKDAY))
    return df.withColumns({
        "opened_at_hour": F.coalesce(F.hour(at), F.lit(DEFAULT_HOUR)),
        "opened_at_dayofweek": weekday,
        "opened_at_month": F.coalesce(F.month(at), F.lit(DEFAULT_MONTH)),
        "is_weekend": (weekday >= 5).cast("int"),
    })


def cyclic(df: DataFrame) -> DataFrame:
    """Sine and cosine of hour and weekday; needs :func:`date_parts`."""
    out = {}
    for c, period in (("opened_at_hour", 24.0), ("opened_at_dayofweek", 7.0)):
        angle = F.col(c) * F.lit(2 * math.pi) / F.lit(period)
        out[f"{c}_sin"], out[f"{c}_cos"] = F.sin(angle), F.cos(angle)
    return df.withColumns(out)


def calendar_flags(df: DataFrame, at: str = "opened_at", holidays=HOLIDAYS) -> DataFrame:
    """Business-hours and holiday flags; needs :func:`date_parts`."""
    hour, weekday = F.col("opened_at_hour"), F.col("opened_at_dayofweek")
    holiday = F.date_format(at, "MM-dd").isin(*holidays)
    return df.withColumns({
        "is_business_hours": ((weekday < 5) & hour.between(BUSINESS_FROM, BUSINESS_TO)).cast("int"),
        "is_holiday": F.coalesce(holiday, F.lit(False)).cast("int"),
    })


def interactions(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    number = lambda c, default: F.coalesce(F.col(c).try_cast("int"), F.lit(default))
    cols = {}
    if {"priority", "business_impact"} <= have:
        cols["priority_x_business_impact"] = number("priority", DEFAULT_PRIORITY) * number("business_impact", DEFAULT_IMPACT)
    if {"priority", "urgency"} <= have:
        cols["priority_x_urgency"] = number("priority", DEFAULT_PRIORITY) * number("urgency", DEFAULT_URGENCY)
    if {"category", "assignment_group"} <= have:
        parts = [F.coalesce(F.col(c), F.lit("Unknown")) for c in ("category", "assignment_group")]
        cols["category_assignment_interaction"] = F.concat_ws("_", *parts)
    return df.withColumns(cols) if cols else df


def resolution_hours(df: DataFrame) -> DataFrame:
    seconds = F.timestamp_diff("MICROSECOND", F.col("opened_at"), F.col("resolved_at")) / F.lit(1e6)
    hours = F.coalesce(F.round(seconds / 3600, 4), F.lit(0.0))
    return df.withColumn("resolution_time_hours", F.greatest(hours, F.lit(0.0)))


def _linked(c: str) -> Column:
    return (F.col(c).isNotNull() & (F.col(c) != "")).cast("int")


def linkage_flags(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    cols = {}
    for source, flag in (("duplicate_incident", "is_duplicate"), ("parent_incident", "has_parent_incident"),
                         ("change_request", "has_change_request")):
        if source in have:
            cols[flag] = F.coalesce(_linked(source), F.lit(0))
    for boolean, reference, flag in (("problem_flag", "problem_id", "has_problem_id"),
                                     ("knowledge_linked", "knowledge_base", "has_knowledge_link")):
        if boolean in have:
            cols[flag] = F.coalesce(F.col(boolean).cast("int"), F.lit(0))
        elif reference in have:
            cols[flag] = F.col(reference).isNotNull().cast("int")
    return df.withColumns(cols) if cols else df


def log_target(hours: Column) -> Column:
    """log1p of the clipped duration; a missing one counts as the default."""
    value = F.coalesce(hours.try_cast("double"), F.lit(TARGET_DEFAULT_HOURS))
    return F.log1p(F.least(F.greatest(value, F.lit(0.0)), F.lit(TARGET_CAP_HOURS)))


def from_log_target(value: Column) -> Column:
    return F.expm1(F.least(F.greatest(value, F.lit(0.0)), F.lit(LOG_CAP)))


def select_with_defaults(df: DataFrame, columns: list[str], text_columns=(), empty_columns=()) -> DataFrame:
    """Select ``columns``; a missing one becomes 'UNKNOWN', '' or 0 by kind."""
    def default(c):
        return F.lit("UNKNOWN") if c in text_columns else F.lit("") if c in empty_columns else F.lit(0)

    return df.select([F.col(c) if c in df.columns else default(c).alias(c) for c in columns])


def engineer(df: DataFrame, holidays=HOLIDAYS) -> DataFrame:
    """All row-local features of a cleaned ticket table."""
    return (
        df.transform(date_parts).transform(cyclic).transform(lambda d: calendar_flags(d, holidays=holidays))
        .transform(interactions).transform(resolution_hours).transform(text_stats).transform(linkage_flags)
    )


def enrich(df: DataFrame, side: DataFrame | None, key: str, suffix: str = "_side") -> DataFrame:
    """Left join an optional side table; clashing column names get a suffix. Repeated side keys fan out."""
    if side is None or key not in side.columns:
        return df
    clash = {c: c + suffix for c in side.columns if c != key and c in df.columns}
    return df.join(side.withColumnsRenamed(clash), key, "left")
