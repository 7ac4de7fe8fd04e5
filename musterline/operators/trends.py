"""Monthly trends, the lead x month heatmap and the latest-month alert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from musterline.functions.codes import MISSING
from musterline.functions.columns import fixed, month_key, month_label, month_start, percent, total
from musterline.operators.day_sets import day_set, days_in

# Heatmap metrics -> trend column, and whether more is better.
HEATMAP_METRICS = {
    "% Deployment": ("deployment_percentage", True),
    "Presence Rate": ("presence_rate", True),
    "Absenteeism Rate": ("absenteeism_rate", False),
}
TREND_RATES = ("presence_rate", "leave_rate", "absenteeism_rate")


def _sums() -> list[Column]:
    return [F.sum(name).alias(name) for name in ("presence", "leave", "lwp", "absent")]


def _balance(sums: DataFrame) -> DataFrame:
    return sums.withColumn("total_absenteeism", F.col("lwp") + F.col("absent")).withColumn(
        "mandays", F.col("presence") + F.col("leave") + F.col("total_absenteeism")
    )


def monthly_trends(daily: DataFrame) -> DataFrame:
    """Sums, days with data and rates per month; rows without a date are left out."""
    months = (
        daily.where(F.col("date").isNotNull())
        .groupBy(month_start("date").alias("month_start"))
        .agg(*_sums(), day_set().alias("days"))
        .withColumn("days_in_data", days_in("days"))
    )
    return (
        _balance(months)
        .select(
            month_key("month_start").alias("month"),
            "presence",
            "leave",
            "lwp",
            "absent",
            "days_in_data",
            "total_absenteeism",
            "mandays",
            percent("presence", "mandays").alias("presence_rate"),
            percent("leave", "mandays").alias("leave_rate"),
            percent("total_absenteeism", "mandays").alias("absenteeism_rate"),
            percent("presence", "mandays").alias("deployment_percentage"),
            month_label("month_start").alias("display_month"),
        )
        .orderBy("month")
    )


def grouped_trends(daily: DataFrame) -> DataFrame:
    """Sums and rates per functional lead and month."""
    groups = (
        daily.where(F.col("date").isNotNull())
        .groupBy(
            month_start("date").alias("month_start"),
            F.coalesce("functional_lead", F.lit(MISSING)).alias("functional_lead"),
        )
        .agg(*_sums())
    )
    return (
        _balance(groups)
        .select(
            month_key("month_start").alias("month"),
            "functional_lead",
            "presence",
            "leave",
            "lwp",
            "absent",
            "total_absenteeism",
            "mandays",
            percent("presence", "mandays").alias("presence_rate"),
            percent("total_absenteeism", "mandays").alias("absenteeism_rate"),
            percent("presence", "mandays").alias("deployment_percentage"),
        )
        .orderBy("functional_lead", "month")
    )


def _as_one_row(monthly: DataFrame, *columns: str) -> DataFrame:
    """All months in one array, in order: the calendar bounds their number."""
    return monthly.agg(
        F.array_sort(F.collect_list(F.struct("month", "display_month", *columns))).alias("months")
    )


def trend_series(monthly: DataFrame) -> DataFrame:
    """Chart series of the three rates; empty with fewer than two months."""
    enough = _as_one_row(monthly, *TREND_RATES).where(F.size("months") >= 2)
    return enough.select(F.inline("months")).unpivot(
        ["month", "display_month"], list(TREND_RATES), "metric", "value"
    )


def team_sizes(employees: DataFrame) -> DataFrame:
    return employees.groupBy("functional_lead").agg(
        F.countDistinct("employee_id").alias("team_size")
    )


def lead_averages(employees: DataFrame, metric: str) -> DataFrame:
    """Overall rate per lead over the whole period, for a heatmap metric."""
    return _lead_sums(employees, metric).select("functional_lead", "overall_avg")


def _lead_sums(employees: DataFrame, metric: str) -> DataFrame:
    column, _ = _metric(metric)
    part = "total_absenteeism" if column == "absenteeism_rate" else "total_presence"
    return (
        employees.groupBy("functional_lead")
        .agg(
            F.countDistinct("employee_id").alias("team_size"),
            total(part).alias("part"),
            total("mandays").alias("mandays"),
        )
        .select("functional_lead", "team_size", percent("part", "mandays").alias("overall_avg"))
    )


def months_of(trends: DataFrame) -> list[str]:
    """The months that become heatmap columns: a short list, bounded by the calendar."""
    return [row.month for row in trends.select("month").distinct().orderBy("month").collect()]


def heatmap_matrix(
    trends: DataFrame, metric: str, months: Sequence[str] | None = None
) -> DataFrame:
    """Lead x month matrix of one metric; a missing cell is 0."""
    column, _ = _metric(metric)
    months = list(months) if months is not None else months_of(trends)
    return (
        trends.groupBy("functional_lead")
        .pivot("month", months)
        .agg(F.avg(column))
        .na.fill(0.0, months)
    )


def heatmap(
    trends: DataFrame,
    employees: DataFrame,
    metric: str,
    months: Sequence[str] | None = None,
) -> DataFrame:
    """Matrix with team size, overall rate and the first-to-last trend, worst first."""
    _, more_is_better = _metric(metric)
    months = list(months) if months is not None else months_of(trends)
    table = _lead_sums(employees, metric).join(
        heatmap_matrix(trends, metric, months), "functional_lead", "inner"
    )
    worst_first = F.asc("overall_avg") if more_is_better else F.desc("overall_avg")
    return table.select(
        "functional_lead",
        "team_size",
        "overall_avg",
        _trend(months, more_is_better).alias("trend"),
        *[F.col(f"`{month}`") for month in months],
    ).orderBy(worst_first, "functional_lead")


def heatmap_rows(trends: DataFrame, employees: DataFrame, metric: str) -> DataFrame:
    """The heatmap as rows: lead, team size, overall rate, trend, month and value.

    A lead's cells are one map by month and all months one array, which the calendar bounds;
    months become no columns, so nothing is collected. Leads without employees are left out.
    """
    column, more_is_better = _metric(metric)
    cells = trends.groupBy("functional_lead", "month").agg(F.avg(column).alias("value"))
    by_lead = cells.groupBy("functional_lead").agg(
        F.map_from_entries(F.collect_list(F.struct("month", "value"))).alias("cells")
    )
    months = trends.agg(F.array_sort(F.collect_set("month"))).scalar()
    filled = F.transform("months", lambda m: F.coalesce(F.col("cells")[m], F.lit(0.0)))
    change = F.element_at("values", -1) - F.element_at("values", 1)
    return (
        _lead_sums(employees, metric)
        .join(by_lead, "functional_lead")
        .withColumn("months", months)
        .withColumn("values", filled)
        .withColumn("trend", _label(change, more_is_better, F.size("months") < 2))
        .select(
            "functional_lead",
            "team_size",
            "overall_avg",
            "trend",
            F.inline(F.arrays_zip(F.col("months").alias("month"), F.col("values").alias("value"))),
        )
    )


def _trend(months: Sequence[str], more_is_better: bool) -> Column:
    if len(months) < 2:
        return F.lit("Stable")
    change = F.col(f"`{months[-1]}`") - F.col(f"`{months[0]}`")
    return _label(change, more_is_better, F.lit(False))


def _label(change: Column, more_is_better: bool, too_few: Column) -> Column:
    better = change > 0 if more_is_better else change < 0
    return (
        F.when(too_few | (F.abs(change) < 0.5), F.lit("Stable"))
        .when(better, F.lit("Improving"))
        .otherwise(F.lit("Worsening"))
    )


def absence_alert(monthly: DataFrame, deviations: float = 1.5) -> DataFrame:
    """Is the latest month's absenteeism above the mean of the earlier months by more
    than `deviations` sample standard deviations? No row with fewer than three months
    or without an alert."""
    one = _as_one_row(monthly, "absenteeism_rate").where(F.size("months") >= 3)
    facts = (
        one.select(
            F.element_at("months", -1).alias("latest"),
            F.expr("slice(months, 1, size(months) - 1).absenteeism_rate").alias("earlier"),
        )
        .withColumn("average", F.expr("aggregate(earlier, 0D, (s, x) -> s + x) / size(earlier)"))
        .selectExpr(
            "latest.month AS month",
            "latest.display_month AS display_month",
            "latest.absenteeism_rate AS latest_rate",
            "average AS historical_avg",
            "sqrt(aggregate(earlier, 0D, (s, x) -> s + (x - average) * (x - average))"
            " / (size(earlier) - 1)) AS historical_std",
        )
    )
    average = F.col("historical_avg")
    rise = F.when(average > 0, (F.col("latest_rate") - average) / average * 100).otherwise(
        F.lit(100.0)
    )
    text = F.concat(
        F.lit("**Strategic Alert:** Absenteeism for **"),
        F.col("display_month"),
        F.lit(" at "),
        fixed("latest_rate", 1),
        F.lit("%** is significantly higher than the historical average of "),
        fixed("historical_avg", 1),
        F.lit("%. This represents a **"),
        fixed("percent_increase", 0),
        F.lit("% increase**, warranting investigation."),
    )
    return (
        facts.withColumn("threshold", average + F.lit(deviations) * F.col("historical_std"))
        .where(F.col("latest_rate") > F.col("threshold"))
        .withColumn("percent_increase", rise)
        .withColumn("alert", text)
    )


def _metric(metric: str) -> tuple[str, bool]:
    if metric not in HEATMAP_METRICS:
        raise ValueError(f"unknown heatmap metric {metric!r}: use one of {list(HEATMAP_METRICS)}")
    return HEATMAP_METRICS[metric]
