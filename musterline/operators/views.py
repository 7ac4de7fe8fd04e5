"""Filtered views and drill-downs into the rows behind a number."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from musterline.functions.codes import AS_OBSERVED, CodeBook

# Drill-down metric -> code set and the employee total it ranks by.
DRILLDOWNS = {
    "Deployment": ("presence", "total_presence"),
    "Absenteeism Rate": ("absence", "total_absenteeism"),
    "Mandays Worked": ("presence", "total_presence"),
    "Mandays Lost": ("absence", "total_absenteeism"),
    "Presence Rate": ("presence", "total_presence"),
    "Leave Rate": ("leave", "total_leave"),
}


def cascade_filter(
    frame: DataFrame,
    units: Sequence[str] | None = None,
    leads: Sequence[str] | None = None,
    managers: Sequence[str] | None = None,
) -> DataFrame:
    """Keep the selected units, leads and managers.

    None selects everything on that level, an empty list nothing. The three columns
    are in employee and daily rows alike: filtering daily rows by the same selection
    reaches the scan and spares a join.
    """
    for column, chosen in (
        ("ou_name", units),
        ("functional_lead", leads),
        ("reporting_manager", managers),
    ):
        if chosen is not None:
            frame = frame.where(F.col(column).isin(*chosen) if chosen else F.lit(False))
    return frame


def filter_options(frame: DataFrame, column: str) -> DataFrame:
    """Sorted choices of one filter level, on the frame filtered so far."""
    return frame.select(column).distinct().orderBy(column)


def daily_in_view(daily: DataFrame, employees: DataFrame) -> DataFrame:
    """Daily rows of the employees in view."""
    return daily.join(employees.select("employee_id"), "employee_id", "left_semi")


def drilldown_rows(daily: DataFrame, metric: str, book: CodeBook = AS_OBSERVED) -> DataFrame:
    """Daily rows with any part of the code in the metric's code set."""
    codes, _ = _drilldown(metric)
    wanted = F.array(*[F.lit(code) for code in getattr(book, codes)])
    return daily.where(F.arrays_overlap(F.split("code", "/"), wanted))


def drilldown_codes(daily: DataFrame, metric: str, book: CodeBook = AS_OBSERVED) -> DataFrame:
    """How often each code occurs behind a metric, most frequent first."""
    return (
        drilldown_rows(daily, metric, book)
        .groupBy("code")
        .agg(F.count(F.lit(1)).alias("records"))
        .orderBy(F.desc("records"), "code")
    )


def drilldown_records(daily: DataFrame, metric: str, book: CodeBook = AS_OBSERVED) -> DataFrame:
    """The raw records behind a metric, by date and name."""
    return (
        drilldown_rows(daily, metric, book)
        .orderBy("date", "employee_name", "employee_id")
        .select(
            "date",
            "employee_name",
            "reporting_manager",
            "ou_name",
            "code",
            "presence",
            "leave",
            "lwp",
            "absent",
        )
    )


def top_contributors(employees: DataFrame, metric: str, most: int = 5) -> DataFrame:
    """The employees who add most to a metric."""
    _, column = _drilldown(metric)
    return (
        employees.orderBy(F.desc(column), "employee_id")
        .limit(most)
        .select("employee_id", "employee_name", column)
    )


def team_members(employees: DataFrame) -> DataFrame:
    """Members with their day balance, keyed by lead and manager."""
    return employees.select(
        "functional_lead",
        "reporting_manager",
        F.col("employee_id").alias("emp_id"),
        F.col("employee_name").alias("name"),
        F.col("total_presence").alias("present"),
        F.col("total_leave").alias("leave"),
        F.col("total_absenteeism").alias("absent"),
        "mandays",
    )


def _drilldown(metric: str) -> tuple[str, str]:
    if metric not in DRILLDOWNS:
        raise ValueError(f"unknown drill-down {metric!r}: use one of {list(DRILLDOWNS)}")
    return DRILLDOWNS[metric]
