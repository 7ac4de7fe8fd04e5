"""The downloadable report: a summary sheet and a detail sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from musterline.functions.codes import LEAVE_COLUMNS
from musterline.functions.columns import fixed, month_key, percent, round_half_even
from musterline.session import durable

# Summary lines and the KPI behind each.
SUMMARY_LINES = (
    ("Total Employees in View", "total_employees", "count"),
    ("Overall Presence %", "presence_rate", "rate"),
    ("Overall Leave %", "leave_rate", "rate"),
    ("Overall Absenteeism %", "absenteeism_rate", "rate"),
    ("Total Presence Days (Mandays Worked)", "total_presence", "days"),
    ("Total Leave Days", "total_leave", "days"),
    ("Total Absenteeism Days (Mandays Lost)", "total_absenteeism", "days"),
    ("Total Mandays (Denominator)", "mandays", "days"),
    ("Total Weekend/Holiday Work Days", "total_extra_work_days", "days"),
)


def summary_report(kpis: DataFrame) -> DataFrame:
    """Nine (Metric, Value) lines from a one-row KPI block; values as text."""
    cells: list[Column] = []
    for label, column, kind in SUMMARY_LINES:
        cells += [F.lit(label), _shown(column, kind)]
    return kpis.select(F.stack(F.lit(len(SUMMARY_LINES)), *cells).alias("Metric", "Value"))


def _shown(column: str, kind: str) -> Column:
    if kind == "rate":
        return F.concat(fixed(column, 2), F.lit("%"))
    if kind == "days":
        return _days_text(column)
    return F.col(column).cast("string")


def _days_text(column: str) -> Column:
    """Days are multiples of a half, so one decimal shows them whole."""
    return F.format_string("%.1f", F.col(column))


def detail_report(
    employees: DataFrame, leave_columns: list[str] = LEAVE_COLUMNS
) -> DataFrame:
    """One line per employee with rates and the sum behind its mandays."""
    breakdown = F.concat(
        _days_text("total_presence"),
        F.lit(" (Present) + "),
        _days_text("total_leave"),
        F.lit(" (Leave) + "),
        _days_text("total_absenteeism"),
        F.lit(" (Absent) = "),
        _days_text("mandays"),
        F.lit(" Mandays"),
    )
    return employees.select(
        F.col("employee_id").alias("Employee_ID"),
        F.col("employee_name").alias("Employee_Name"),
        F.col("ou_name").alias("OU_Name"),
        F.col("functional_lead").alias("Functional_Lead"),
        F.col("reporting_manager").alias("Reporting_Manager"),
        F.col("total_presence").alias("presence_days"),
        F.col("total_leave").alias("leave_days"),
        F.col("total_absenteeism").alias("absenteeism_days"),
        F.col("mandays").alias("total_mandays"),
        "deployment_percentage",
        round_half_even(percent("total_presence", "mandays")).alias("presence_percentage"),
        round_half_even(percent("total_absenteeism", "mandays")).alias(
            "absenteeism_percentage"
        ),
        "worked_weekends",
        "worked_holidays",
        breakdown.alias("calculation_breakdown"),
        *sorted(leave_columns),
    )


def write_report(report: DataFrame, path: str, fmt: str = "csv", mode: str = "error") -> None:
    """Write a report as a folder of CSV or Parquet files."""
    writer = report.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}: use 'csv' or 'parquet'")


def write_daily(daily: DataFrame, path: str, mode: str = "error") -> None:
    """Store daily rows by month, so that a period reads only its months.

    The rebalance hint gives each month as many files as its rows need: a month may
    hold most of the rows, and one file per task and month would be far too many.
    """
    months = daily.withColumn("month", month_key("date"))
    months.hint("rebalance", F.col("month")).write.mode(mode).partitionBy("month").parquet(path)


def replace_months(daily: DataFrame, path: str) -> None:
    """Replace the months that `daily` has and leave all others in `path` as they are.

    The rows are written to the shared folder first, so they may come from `path` itself, and
    a failure while they are formed changes nothing. New files are then written aside by Spark
    and take the place of the old ones of their months when all of them are complete. Without
    rows nothing is replaced; rows without a date are a month of their own.
    """
    months = durable(daily.withColumn("month", month_key("date")))
    (
        months.hint("rebalance", F.col("month"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("month")
        .parquet(path)
    )
