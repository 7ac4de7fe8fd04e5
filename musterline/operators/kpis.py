"""KPI blocks over employee rows: company, managers, views and baselines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from musterline.functions.codes import LEAVE_COLUMNS, MISSING
from musterline.functions.columns import month_start, percent, total
from musterline.operators.day_sets import day_set, working_days

RATES = ("presence_rate", "leave_rate", "absenteeism_rate")
TEAM_KEYS = ("functional_lead", "reporting_manager")


def kpi_sums() -> list[Column]:
    """Aggregates from which every rate follows; 0 on an empty group."""
    return [
        F.count(F.lit(1)).alias("total_employees"),
        total("total_presence").alias("total_presence"),
        total("total_leave").alias("total_leave"),
        total("total_absenteeism").alias("total_absenteeism"),
        total("mandays").alias("mandays"),
        (total("worked_weekends") + total("worked_holidays")).alias("total_extra_work_days"),
    ]


def add_rates(sums: DataFrame) -> DataFrame:
    return sums.withColumns(
        {
            "presence_rate": percent("total_presence", "mandays"),
            "leave_rate": percent("total_leave", "mandays"),
            "absenteeism_rate": percent("total_absenteeism", "mandays"),
        }
    )


def leave_sums(leave_columns: Sequence[str] = LEAVE_COLUMNS) -> list[Column]:
    return [total(name).alias(name) for name in leave_columns]


def leave_name(column: str) -> str:
    return column.removeprefix("leave_").upper()


def add_leave_map(sums: DataFrame, leave_columns: Sequence[str] = LEAVE_COLUMNS) -> DataFrame:
    """Fold the leave columns into one map, code -> days."""
    pairs: list[Column] = []
    for name in leave_columns:
        pairs += [F.lit(leave_name(name)), F.col(name)]
    return sums.withColumn("leave_breakdown", F.create_map(*pairs)).drop(*leave_columns)


def group_kpis(
    employees: DataFrame, *keys: str, leave_columns: Sequence[str] = LEAVE_COLUMNS
) -> DataFrame:
    """The KPI block of any group, `leave_*` sums included; one row without keys."""
    return add_rates(
        employees.groupBy(*keys).agg(*kpi_sums(), *leave_sums(leave_columns))
    )


def leave_breakdown(
    employees: DataFrame, leave_columns: Sequence[str] = LEAVE_COLUMNS
) -> DataFrame:
    """Leave type and days, one row per type, by type."""
    sums = employees.agg(*leave_sums(leave_columns))
    cells: list[Column] = []
    for name in leave_columns:
        cells += [F.lit(leave_name(name)), F.col(name)]
    return sums.select(
        F.stack(F.lit(len(leave_columns)), *cells).alias("leave_type", "days")
    ).orderBy("leave_type")


def quality_counts() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total_employees_processed"),
        F.count_if(F.col("reporting_manager") == MISSING).alias("employees_missing_manager_name"),
        F.count_if(F.col("mandays") <= 0).alias("employees_with_zero_mandays"),
    ]


def data_quality(employees: DataFrame) -> DataFrame:
    return employees.agg(*quality_counts())


def _with_lead(employees: DataFrame) -> DataFrame:
    if "functional_lead" in employees.columns:
        return employees
    return employees.withColumn("functional_lead", F.lit(MISSING))


def manager_kpis(employees: DataFrame) -> DataFrame:
    """Team size and rates per functional lead and manager."""
    kpis = add_rates(_with_lead(employees).groupBy(*TEAM_KEYS).agg(*kpi_sums()))
    return kpis.select(
        F.col("reporting_manager").alias("manager_name"),
        F.col("total_employees").alias("team_size"),
        *RATES,
        "functional_lead",
    )


def company_and_manager_kpis(employees: DataFrame) -> DataFrame:
    """Company row and manager rows from one pass; `level` tells them apart."""
    named = _with_lead(employees)
    keys = [F.col(name) for name in TEAM_KEYS]
    sums = named.groupingSets([[], keys], *keys).agg(
        F.grouping_id().alias("grouping"), *kpi_sums()
    )
    return add_rates(sums).select(
        F.when(F.col("grouping") == 0, F.lit("manager")).otherwise(F.lit("company")).alias("level"),
        *TEAM_KEYS,
        "total_employees",
        *RATES,
        "total_presence",
        "total_leave",
        "total_absenteeism",
        "mandays",
        "total_extra_work_days",
    )


def manager_teams(employees: DataFrame) -> DataFrame:
    """One row per member of each manager's team, whatever the team's size."""
    named = _with_lead(employees)
    others = [n for n in named.columns if n not in (*TEAM_KEYS, "employee_id")]
    return named.select(*TEAM_KEYS, "employee_id", *others)


def period_working_days(daily: DataFrame) -> DataFrame:
    """Distinct dates with a record; 0 on no rows, null dates not counted."""
    dated = daily.where(F.col("date").isNotNull())
    months = dated.groupBy(month_start("date").alias("month_start")).agg(day_set().alias("days"))
    return working_days(months).withColumnRenamed("working_days", "period_working_days")


def attendance_summary(
    employees: DataFrame, period: str, daily: DataFrame | None = None
) -> DataFrame:
    """One row: label, data quality, KPIs and working days. No employees give zeros."""
    quality = [c for c in quality_counts()[1:]]
    sums = add_rates(employees.agg(*kpi_sums(), *quality, *leave_sums()))
    empty = F.col("total_employees") == 0
    days = period_working_days(daily).scalar() if daily is not None else F.lit(0).cast("long")
    return sums.select(
        F.concat(
            F.when(empty, F.lit("No data for: ")).otherwise(F.lit("Analysis for: ")),
            F.lit(period),
        ).alias("analysis_period"),
        F.col("total_employees").alias("total_employees_processed"),
        "employees_missing_manager_name",
        "employees_with_zero_mandays",
        "total_employees",
        *RATES,
        "total_presence",
        "total_leave",
        "total_absenteeism",
        "mandays",
        "total_extra_work_days",
        *LEAVE_COLUMNS,
        F.when(empty, F.lit(0).cast("long")).otherwise(days).alias("period_max_working_days"),
    )


def baseline_kpis(view: DataFrame, master: DataFrame) -> DataFrame:
    """KPIs to hold a view against: the other units for a one-unit view, else the company.

    Master rows are summed per unit, the view's rows counted per unit, and the two meet by unit:
    what is left is one row per unit, from which both baselines follow. Nothing is collected. An
    empty view gives zeros without a name; a unit without a name is in no comparison.
    """
    per_unit = master.groupBy("ou_name").agg(*kpi_sums(), *leave_sums())
    names = [name for name in per_unit.columns if name != "ou_name"]
    seen = view.groupBy("ou_name").agg(F.count(F.lit(1)).alias("view_rows"))
    units = per_unit.withColumn("known", F.lit(True)).join(
        seen.withColumnRenamed("ou_name", "view_unit"),
        F.col("ou_name").eqNullSafe(F.col("view_unit")) & F.col("known"),
        "full",
    )
    peer = "view_rows IS NULL AND ou_name IS NOT NULL"
    both = units.agg(
        *[F.expr(f"sum({name})").alias(name) for name in names],
        *[F.expr(f"sum({name}) FILTER (WHERE {peer})").alias(f"peer_{name}") for name in names],
        F.expr("count(known)").alias("units"),
        F.expr(f"count_if({peer})").alias("peer_units"),
        F.expr("coalesce(sum(view_rows), 0) > 0").alias("seen"),
        F.expr("count_if(view_rows IS NOT NULL AND view_unit IS NOT NULL)").alias("view_units"),
    )
    by_peers = (F.col("view_units") == 1) & (F.col("units") > 1)
    against = both.withColumn("by_peers", by_peers).selectExpr(
        *[
            f"CASE WHEN NOT seen OR units = 0 THEN 0 WHEN by_peers THEN peer_{name} ELSE {name} END"
            f" AS {name}"
            for name in names
        ],
        "CASE WHEN NOT seen OR units = 0 THEN NULL"
        " WHEN by_peers THEN concat('vs. Peer Avg. (', peer_units, ' OUs)')"
        " ELSE 'vs. Company Avg.' END AS baseline_name",
    )
    return add_rates(against)


def view_cards(employees: DataFrame) -> DataFrame:
    """Totals and rates shown for a filtered view."""
    sums = add_rates(employees.agg(*kpi_sums()))
    return sums.select(
        "total_employees",
        "mandays",
        "total_presence",
        "total_leave",
        "total_absenteeism",
        F.col("presence_rate").alias("deployment_percentage"),
        *RATES,
    )


def capacity(employees: DataFrame, daily: DataFrame) -> DataFrame:
    """Standard capacity = headcount x working days, and the gap to actual mandays."""
    days = period_working_days(daily).scalar()
    sums = employees.agg(
        F.count(F.lit(1)).alias("headcount"), total("mandays").alias("mandays")
    )
    facts = (
        sums.withColumn("period_working_days", days)
        .withColumn("standard_capacity", F.col("headcount") * F.col("period_working_days"))
        .withColumn("capacity_gap", F.col("standard_capacity") - F.col("mandays"))
    )
    flag = F.when(
        F.col("capacity_gap") > 0, F.format_string("Gap: -%,.1f Days", F.col("capacity_gap"))
    ).otherwise(F.lit("Full Capacity"))
    return facts.withColumn("capacity_flag", flag)


def absence_cost(employees: DataFrame, daily_cost: float = 100.0) -> DataFrame:
    return employees.agg(total("total_absenteeism").alias("total_absenteeism")).withColumn(
        "estimated_cost", F.col("total_absenteeism") * F.lit(float(daily_cost))
    )


def team_rollup(employees: DataFrame, daily: DataFrame, alert_above: float = 7.0) -> DataFrame:
    """Lead -> manager: size, mandays against capacity, absenteeism rate and its flag."""
    days = period_working_days(daily).scalar()
    teams = _with_lead(employees).groupBy(*TEAM_KEYS).agg(
        F.count(F.lit(1)).alias("team_size"),
        total("mandays").alias("mandays"),
        total("total_absenteeism").alias("total_absenteeism"),
    )
    rate = percent("total_absenteeism", "mandays")
    return (
        teams.withColumn("standard_capacity", F.col("team_size") * days)
        .withColumn("absenteeism_rate", rate)
        .withColumn(
            "status",
            F.when(F.col("absenteeism_rate") > alert_above, F.lit("alert")).otherwise(F.lit("ok")),
        )
        .orderBy(*TEAM_KEYS)
    )


def briefing_facts(employees: DataFrame, streaks: DataFrame, patterns: DataFrame) -> DataFrame:
    """The numbers of an executive briefing, in one row."""
    streak_rows = streaks.agg(F.count(F.lit(1)).alias("n")).scalar()
    pattern_rows = patterns.agg(F.count(F.lit(1)).alias("n")).scalar()
    return view_cards(employees).select(
        "total_employees",
        "deployment_percentage",
        F.col("total_presence").alias("mandays_worked"),
        F.col("total_absenteeism").alias("mandays_lost"),
        streak_rows.alias("long_absences"),
        pattern_rows.alias("weekday_patterns"),
    )
