"""Daily metrics -> one row per employee."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from musterline.functions.codes import AS_OBSERVED, EMPLOYEE_KEYS, CodeBook
from musterline.functions.columns import percent, round_half_even


def employee_totals(daily: DataFrame, book: CodeBook = AS_OBSERVED) -> DataFrame:
    """Totals per employee, then absenteeism, mandays and deployment.

    Metrics are summed on the map side first. Daily rows that come from
    consolidated employees are already placed by ID, so no shuffle is added.
    """
    renamed = {"presence": "total_presence", "leave": "total_leave"}
    sums = [F.sum(name).alias(renamed.get(name, name)) for name in book.day_metrics()]
    totals = daily.groupBy(*EMPLOYEE_KEYS).agg(
        *sums, F.min("relieving_date").alias("relieving_date")
    )
    return add_day_balance(totals)


def add_day_balance(totals: DataFrame) -> DataFrame:
    lost = F.col("lwp") + F.col("absent")
    return (
        totals.withColumn("total_absenteeism", lost)
        .withColumn(
            "mandays",
            F.col("total_presence") + F.col("total_leave") + F.col("total_absenteeism"),
        )
        .withColumn(
            "deployment_percentage", round_half_even(percent("total_presence", "mandays"))
        )
    )
