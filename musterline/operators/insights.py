"""Absence streaks and weekday patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from musterline.functions.columns import day_text, round_half_even

# The codes these insights look at, as whole codes.
STREAK_CODES = ("LWP", "ABSENT")
PATTERN_CODES = ("CL", "SL", "LWP", "ABSENT")
# A gap of more than three days ends a streak (day numbers: Sunday = 1).
LARGEST_GAP = 3
PATTERN_DAYS = {"Monday": 2, "Friday": 6}


def valid_absences(daily: DataFrame) -> DataFrame:
    """Whole-day absences up to the relieving date, if there is one."""
    return daily.where(
        F.col("code").isin(*STREAK_CODES)
        & (F.col("relieving_date").isNull() | (F.col("date") <= F.col("relieving_date")))
    )


def absence_gaps(daily: DataFrame) -> DataFrame:
    """Absence dates per employee with the days since the one before.

    Repeated dates are counted before the window, so the rows of one employee in a
    window are bounded by the calendar. Null dates come last, as no break.
    """
    days = (
        valid_absences(daily)
        .groupBy("employee_id", "employee_name", "date")
        .agg(F.count(F.lit(1)).alias("records"))
    )
    return days.withColumn("gap_days", F.datediff("date", F.lag("date").over(_by_date())))


def streak_ids(daily: DataFrame) -> DataFrame:
    """Number the streaks of each employee from 0."""
    breaks = F.when(F.col("gap_days") > LARGEST_GAP, 1).otherwise(0)
    running = _by_date().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return absence_gaps(daily).withColumn("streak_id", F.sum(breaks).over(running))


def absence_streaks(daily: DataFrame, streak_threshold: int = 4) -> DataFrame:
    """Streaks of at least `streak_threshold` absences, longest first."""
    return (
        streak_ids(daily)
        .groupBy("employee_id", "employee_name", "streak_id")
        .agg(
            F.sum("records").alias("consecutive_days"),
            F.min("date").alias("first_date"),
            F.max("date").alias("last_date"),
        )
        .where(F.col("consecutive_days") >= streak_threshold)
        .select(
            "employee_id",
            "employee_name",
            "consecutive_days",
            day_text("first_date").alias("absence_start_date"),
            day_text("last_date").alias("absence_end_date"),
        )
        .orderBy(F.desc("consecutive_days"), "employee_id", "absence_start_date")
    )


def _by_date():
    return Window.partitionBy("employee_id").orderBy(
        F.asc_nulls_last("date"), F.asc("employee_name")
    )


def leave_day_counts(daily: DataFrame, significance_threshold: int = 4) -> DataFrame:
    """Leave days per employee, in total and on the pattern days, in one grouping."""
    weekday = F.dayofweek("date")
    return (
        daily.where(F.col("code").isin(*PATTERN_CODES))
        .groupBy("employee_id")
        .agg(
            F.count(F.lit(1)).alias("total_leaves"),
            *[F.count_if(weekday == day).alias(name) for name, day in PATTERN_DAYS.items()],
        )
        .where(F.col("total_leaves") >= significance_threshold)
    )


def weekday_shares(
    daily: DataFrame, pattern_threshold_pct: float = 40, significance_threshold: int = 4
) -> DataFrame:
    """Share of an employee's leave days on Mondays or Fridays, where it is high."""
    return (
        leave_day_counts(daily, significance_threshold)
        .unpivot(
            ["employee_id", "total_leaves"], list(PATTERN_DAYS), "day_of_week", "pattern_days"
        )
        .where(F.col("pattern_days") > 0)
        .withColumn("pattern_pct", F.col("pattern_days") / F.col("total_leaves") * 100)
        .where(F.col("pattern_pct") >= pattern_threshold_pct)
    )


def weekday_patterns(
    daily: DataFrame,
    employees: DataFrame,
    pattern_threshold_pct: float = 40,
    significance_threshold: int = 4,
) -> DataFrame:
    """Weekday shares with employee names and a sentence, highest share first."""
    shares = weekday_shares(daily, pattern_threshold_pct, significance_threshold)
    sentence = F.concat(
        round_half_even("pattern_pct", 0).cast("long").cast("string"),
        F.lit("% of their "),
        F.col("total_leaves").cast("string"),
        F.lit(" leaves were on "),
        F.col("day_of_week"),
        F.lit("s"),
    )
    return (
        shares.join(employees.select("employee_id", "employee_name"), "employee_id", "left")
        .select(
            "employee_id",
            "employee_name",
            "day_of_week",
            "total_leaves",
            "pattern_days",
            "pattern_pct",
            sentence.alias("description"),
        )
        .orderBy(F.desc("pattern_pct"), "employee_id", "day_of_week")
    )
