"""Date expressions; today is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def feed_date(c: Column) -> Column:
    """'Thu, 13 Aug 2026 07:00:00 GMT' to a date."""
    return F.try_to_date(F.substring(c, 6, 11), "dd MMM yyyy")


def numeric_date(c: Column) -> Column:
    """20260813 or 20260813070000 to a date."""
    s = c.cast("string")
    return F.when(F.length(s).isin(8, 14), F.try_to_date(F.substring(s, 1, 8), "yyyyMMdd"))


def sanitize_date(c: Column, published: Column, as_of: Column) -> Column:
    """The date in the first ten characters; the published date, or today, where it can't be read or lies ahead."""
    d = F.try_to_date(F.substring(F.coalesce(c, F.lit("")), 1, 10), "yyyy-M-d")
    return F.when(d <= as_of, d).otherwise(F.coalesce(published, as_of))


def stale_guard(extracted: Column, published: Column) -> Column:
    """Extracted dates of 2023 and 2024, and empty ones, give way to the published date."""
    return F.when(F.coalesce(F.nullif(extracted, F.lit("")).isNull(), F.lit(True)) | extracted.rlike("^202[34]"), published).otherwise(extracted)


def coerced_date(c: Column, default: str = "2026-08-14") -> Column:
    return F.when(F.length(c) >= 10, F.substring(c, 1, 10)).otherwise(default)


def yesterday(today: Column) -> Column:
    return F.date_sub(today, 1)


def spine(df: DataFrame, date_col: str, until: Column) -> DataFrame:
    """Every day from the first date to `until`; the dates themselves where the first is later."""
    span = df.agg(F.min(date_col).alias("a"), F.collect_set(date_col).alias("dates"))
    return span.select(F.explode(F.when(F.col("a") <= until, F.sequence(F.col("a"), until)).otherwise(F.col("dates"))).alias("date"))


def step_window(start: Column, end: Column, days: int, least: Column, most: Column) -> tuple[Column, Column]:
    """Both ends moved by so many days within the bounds, start first."""
    a, b = (F.greatest(least, F.least(most, F.date_add(x, days))) for x in (start, end))
    return F.least(a, b), F.greatest(a, b)


def clamped_handles(start: Column, end: Column, least: Column, most: Column) -> tuple[Column, Column]:
    """Two handles of a slider within its bounds, the first never past the second."""
    a, b = F.greatest(least, F.least(most, start)), F.greatest(least, F.least(most, end))
    return F.least(a, b), F.greatest(a, b)


def window_share(start: Column, end: Column, least: Column, most: Column) -> tuple[Column, Column]:
    """Places of both handles in percent of the bounds; null if these are one day."""
    days = F.nullif(F.date_diff(most, least), F.lit(0))
    return 100.0 * F.date_diff(start, least) / days, 100.0 * F.date_diff(end, least) / days
