"""Trend queries over the many-month attendance."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from musterline.catalog import sql
from musterline.catalog.registry import query
from musterline.catalog.sql import HISTORY, percent, with_daily, with_employee
from musterline.operators import day_sets, trends, views
from musterline.plans.attendance import Attendance, analyse_days
from musterline.session import durable
from musterline.sources import derived


def history(spark, sf_dir) -> Attendance:
    return analyse_days(derived.attendance_history(spark, sf_dir))


MONTHLY = f"""m AS (
  SELECT strftime(date, '%Y-%m') AS month, sum(presence) AS presence, sum("leave") AS "leave",
    sum(lwp) AS lwp, sum(absent) AS absent, count(DISTINCT date) AS days_in_data,
    strftime(min(date), '%b %Y') AS display_month
  FROM daily WHERE date IS NOT NULL GROUP BY strftime(date, '%Y-%m')),
mb AS (SELECT *, lwp + absent AS total_absenteeism, presence + "leave" + (lwp + absent) AS mandays FROM m),
monthly AS (
  SELECT *, {percent("presence", "mandays")} AS presence_rate,
    {percent('"leave"', "mandays")} AS leave_rate,
    {percent("total_absenteeism", "mandays")} AS absenteeism_rate,
    {percent("presence", "mandays")} AS deployment_percentage
  FROM mb)"""

GROUPED = f"""g AS (
  SELECT strftime(date, '%Y-%m') AS month, coalesce(functional_lead, 'N/A') AS functional_lead,
    sum(presence) AS presence, sum("leave") AS "leave", sum(lwp) AS lwp, sum(absent) AS absent
  FROM daily WHERE date IS NOT NULL GROUP BY ALL),
gb AS (SELECT *, lwp + absent AS total_absenteeism, presence + "leave" + (lwp + absent) AS mandays FROM g),
grouped AS (
  SELECT *, {percent("presence", "mandays")} AS presence_rate,
    {percent("total_absenteeism", "mandays")} AS absenteeism_rate,
    {percent("presence", "mandays")} AS deployment_percentage
  FROM gb)"""


@query("monthly_trends", with_daily(f", {MONTHLY} SELECT * FROM monthly", HISTORY))
def monthly_trends(spark, sf_dir):
    return trends.monthly_trends(history(spark, sf_dir).daily)


@query("grouped_trends", with_daily(f", {GROUPED} SELECT * FROM grouped", HISTORY))
def grouped_trends(spark, sf_dir):
    return trends.grouped_trends(history(spark, sf_dir).daily)


@query(
    "trend_series",
    with_daily(
        f", {MONTHLY} "
        + " UNION ALL ".join(
            f"SELECT month, display_month, '{rate}' AS metric, {rate} AS value FROM monthly"
            for rate in trends.TREND_RATES
        ),
        HISTORY,
    ),
)
def trend_series(spark, sf_dir):
    return trends.trend_series(trends.monthly_trends(history(spark, sf_dir).daily))


@query(
    "team_sizes",
    with_employee(
        "SELECT functional_lead, count(DISTINCT employee_id) AS team_size FROM employee GROUP BY 1",
        HISTORY,
    ),
)
def team_sizes(spark, sf_dir):
    return trends.team_sizes(history(spark, sf_dir).employees)


def _lead_average(metric: str) -> str:
    part = "total_absenteeism" if metric == "Absenteeism Rate" else "total_presence"
    return percent(f"sum({part})", "sum(mandays)")


@query(
    "lead_averages",
    with_employee(
        f"SELECT functional_lead, {_lead_average('Absenteeism Rate')} AS overall_avg"
        " FROM employee GROUP BY 1",
        HISTORY,
    ),
)
def lead_averages(spark, sf_dir):
    return trends.lead_averages(history(spark, sf_dir).employees, "Absenteeism Rate")


def _cells_as_rows(table: DataFrame, ids: list[str]) -> DataFrame:
    """Month columns as rows: which months there are depends on the data."""
    months = [name for name in table.columns if name not in ids]
    return table.unpivot(ids, [F.col(f"`{m}`") for m in months], "month", "value")


_CELLS = """cells AS (
  SELECT l.functional_lead, mm.month, coalesce(c.value, 0.0::DOUBLE) AS value
  FROM (SELECT DISTINCT functional_lead FROM grouped) l,
    (SELECT DISTINCT month FROM grouped) mm
  LEFT JOIN (SELECT functional_lead, month, {column} AS value FROM grouped) c
    ON c.functional_lead = l.functional_lead AND c.month = mm.month)"""


@query(
    "heatmap_matrix",
    with_daily(
        f", {GROUPED}, {_CELLS.format(column='deployment_percentage')} SELECT * FROM cells", HISTORY
    ),
)
def heatmap_matrix(spark, sf_dir):
    grouped = trends.grouped_trends(history(spark, sf_dir).daily)
    return _cells_as_rows(trends.heatmap_matrix(grouped, "% Deployment"), ["functional_lead"])


def _heatmap(metric: str) -> None:
    column, more_is_better = trends.HEATMAP_METRICS[metric]
    better = "last_value > first_value" if more_is_better else "last_value < first_value"

    @query(
        f"heatmap_{column}",
        with_employee(
            f""", {GROUPED}, {_CELLS.format(column=column)},
            leads AS (SELECT functional_lead, count(DISTINCT employee_id) AS team_size,
              {_lead_average(metric)} AS overall_avg FROM employee GROUP BY 1),
            ends AS (SELECT functional_lead, min_by(value, month) AS first_value,
              max_by(value, month) AS last_value, count(*) AS months FROM cells GROUP BY 1)
            SELECT functional_lead, team_size, overall_avg,
              CASE WHEN months < 2 OR abs(first_value - last_value) < 0.5 THEN 'Stable'
                WHEN {better} THEN 'Improving' ELSE 'Worsening' END AS trend,
              month, value
            FROM leads JOIN ends USING (functional_lead) JOIN cells USING (functional_lead)""",
            HISTORY,
        ),
    )
    def heatmap(spark, sf_dir):
        return history(spark, sf_dir).heatmap_rows(metric)


for _metric in trends.HEATMAP_METRICS:
    _heatmap(_metric)


@query(
    "working_days_of_views",
    with_daily(
        """SELECT functional_lead, count(DISTINCT date) AS working_days FROM daily
        WHERE ou_name IN ('BUILDING', 'MACHINERY') GROUP BY functional_lead
        UNION ALL SELECT 'all', count(DISTINCT date) FROM daily""",
        HISTORY,
    ),
)
def working_days_of_views(spark, sf_dir):
    """Distinct days by lead within two units, and over all, from one small table."""
    sets = durable(history(spark, sf_dir).day_sets())
    chosen = views.cascade_filter(sets, units=["BUILDING", "MACHINERY"])
    every = day_sets.working_days(sets).select(F.lit("all").alias("functional_lead"), "working_days")
    return day_sets.working_days(chosen, "functional_lead").unionByName(every)


@query(
    "heatmap_wide",
    with_employee(
        f""", {GROUPED}, {_CELLS.format(column='absenteeism_rate')},
        leads AS (SELECT functional_lead, count(DISTINCT employee_id) AS team_size
          FROM employee GROUP BY 1)
        SELECT functional_lead, team_size, month, value FROM leads JOIN cells USING (functional_lead)""",
        HISTORY,
    ),
)
def heatmap_wide(spark, sf_dir):
    """The table with a column per month, as it is written to a report."""
    table = history(spark, sf_dir).heatmap("Absenteeism Rate").drop("overall_avg", "trend")
    return _cells_as_rows(table, ["functional_lead", "team_size"])


_ALERT = f"""{MONTHLY},
latest AS (SELECT max(month) AS month, count(*) AS months FROM monthly),
past AS (SELECT avg(absenteeism_rate) AS a, stddev_samp(absenteeism_rate) AS s
  FROM monthly WHERE month < (SELECT month FROM latest)),
facts AS (
  SELECT monthly.month, display_month, absenteeism_rate AS latest_rate, a AS historical_avg,
    s AS historical_std, months, a + {{deviations}} * s AS threshold,
    CASE WHEN a > 0 THEN (absenteeism_rate - a) / a * 100 ELSE 100.0::DOUBLE END AS percent_increase
  FROM monthly JOIN latest USING (month), past)
SELECT month, display_month, round(latest_rate, 6) AS latest_rate,
  round(historical_avg, 6) AS historical_avg, round(historical_std, 6) AS historical_std,
  round(threshold, 6) AS threshold, round(percent_increase, 6) AS percent_increase,
  '**Strategic Alert:** Absenteeism for **' || display_month || ' at '
    || printf('%.1f', latest_rate)
    || '%** is significantly higher than the historical average of '
    || printf('%.1f', historical_avg) || '%. This represents a **'
    || printf('%.0f', percent_increase)
    || '% increase**, warranting investigation.' AS alert
FROM facts WHERE months >= 3 AND latest_rate > threshold"""


def _alert(name: str, deviations: float) -> None:
    @query(name, with_daily(", " + _ALERT.format(deviations=deviations), HISTORY))
    def alert(spark, sf_dir):
        monthly = trends.monthly_trends(history(spark, sf_dir).daily)
        found = trends.absence_alert(monthly, deviations)
        return found.withColumns(
            {
                column: F.round(column, 6)
                for column in (
                    "latest_rate",
                    "historical_avg",
                    "historical_std",
                    "threshold",
                    "percent_increase",
                )
            }
        )


_alert("absence_alert", 1.5)
# The data may hold no alert: a threshold far below the mean shows the row itself.
_alert("absence_alert_any_month", -50.0)
