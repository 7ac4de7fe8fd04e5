"""Distinct days as bitmaps: exact, one number per group and month, merged by OR.

Days of two groups may overlap, so their counts cannot be added; their bitmaps can be
merged. A table of them by unit, lead, manager and month is small whatever the number of
daily rows, and gives the working days of any view without a further scan of these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from musterline.functions.columns import month_start

# What views are chosen by.
VIEW_KEYS = ("ou_name", "functional_lead", "reporting_manager")


def day_set(date: str = "date") -> Column:
    """Aggregate: the days of one month as bits 1 to 31; null dates set none."""
    return F.expr(f"bit_or(shiftleft(1L, day({date})))")


def days_in(days: Column | str) -> Column:
    """Number of days of a set; a group without dates has none."""
    days = F.col(days) if isinstance(days, str) else days
    return F.coalesce(F.bit_count(days), F.lit(0)).cast("long")


def day_sets(daily: DataFrame, *keys: str) -> DataFrame:
    """*keys, month_start, days: the days with a record by group and month."""
    dated = daily.where(F.col("date").isNotNull())
    return dated.groupBy(*(keys or VIEW_KEYS), month_start("date").alias("month_start")).agg(
        day_set().alias("days")
    )


def working_days(sets: DataFrame, *keys: str) -> DataFrame:
    """Distinct days by `keys`, or one row for all: months are merged first, then counted."""
    months = sets.groupBy(*keys, "month_start").agg(F.bit_or("days").alias("days"))
    counted = F.coalesce(F.sum(days_in("days")), F.lit(0)).alias("working_days")
    return months.groupBy(*keys).agg(counted) if keys else months.agg(counted)
