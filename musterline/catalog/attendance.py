"""Attendance queries: cleaning, daily metrics, KPIs, insights, scorecard, views, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from musterline.catalog import sql
from musterline.catalog.registry import query
from musterline.catalog.sql import with_daily, with_employee
from musterline.functions import codes as cb
from musterline.functions import columns as cols
from musterline.functions import dates
from musterline.operators import cleaning, days, employees, insights, kpis, scorecard, views
from musterline.plans.attendance import Attendance, analyse_days, analyse_grid, analyse_grids
from musterline.session import shared_folder
from musterline.sinks import reports
from musterline.sources import derived, read_grid, read_grids

DAILY_COLUMNS = "employee_id, employee_name, reporting_manager, email_id, ou_name, functional_lead"


def month(spark: SparkSession, sf_dir: str) -> Attendance:
    return analyse_days(derived.attendance_month(spark, sf_dir))


def dates_as_text(frame: DataFrame) -> DataFrame:
    """Dates as text, which compare equal between engines."""
    return frame.withColumns(
        {
            field.name: F.col(field.name).cast("string")
            for field in frame.schema.fields
            if field.dataType.typeName() == "date"
        }
    )


# --- cleaning ---------------------------------------------------------------


@query(
    "grid_unpivot",
    f"WITH {sql.MONTH} SELECT employee_id, employee_name, reporting_manager, 'N/A' AS email_id,"
    " ou_name, functional_lead, CAST(relieving_date AS VARCHAR) AS relieving_date,"
    " CAST(date AS VARCHAR) AS date, raw_code FROM month_rows",
)
def grid_unpivot(spark, sf_dir):
    grid = cleaning.check_grid(
        cleaning.standardise_headers(derived.attendance_grid(spark, sf_dir))
    )
    long = cleaning.unpivot_days(cleaning.add_missing_metadata(grid))
    return dates_as_text(long.where(F.col("raw_code").isNotNull()))


@query(
    "grid_to_daily",
    with_daily(
        f"SELECT {DAILY_COLUMNS}, CAST(relieving_date AS VARCHAR) AS relieving_date,"
        f" CAST(date AS VARCHAR) AS date, code, {sql.METRICS} FROM daily"
    ),
)
def grid_to_daily(spark, sf_dir):
    return dates_as_text(analyse_grid(derived.attendance_grid(spark, sf_dir)).daily)


@query(
    "keep_employees",
    f"WITH {sql.MONTH} SELECT employee_id, CAST(date AS VARCHAR) AS date, raw_code FROM month_rows"
    " WHERE NOT regexp_matches(lower(employee_id), '123|fc|pc')",
)
def keep_employees(spark, sf_dir):
    padded = derived.attendance_month(spark, sf_dir).withColumn(
        "employee_id", F.concat(F.lit(" "), "employee_id", F.lit("  "))
    )
    return dates_as_text(
        cleaning.keep_employees(padded).select("employee_id", "date", "raw_code")
    )


@query(
    "employee_metadata",
    """SELECT CAST(c_custkey AS VARCHAR) AS employee_id, c_name AS employee_name,
         CASE WHEN c_acctbal > 0 THEN 'M' || CAST(c_nationkey AS VARCHAR) ELSE 'N/A' END AS reporting_manager,
         'N/A' AS email_id, coalesce(nullif(c_mktsegment, 'BUILDING'), 'N/A') AS ou_name,
         'N/A' AS functional_lead, TRUE AS no_relieving_date
       FROM customer""",
)
def employee_metadata(spark, sf_dir):
    customer = derived.table(spark, sf_dir, "customer")
    rows = customer.select(
        F.col("c_custkey").alias("employee_id"),
        F.col("c_name").alias("employee_name"),
        F.when(
            F.col("c_acctbal") > 0, F.concat(F.lit("M"), F.col("c_nationkey").cast("string"))
        ).alias("reporting_manager"),
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("ou_name"),
    )
    filled = cleaning.fill_metadata(cleaning.add_missing_metadata(rows))
    return filled.withColumn("no_relieving_date", F.col("relieving_date").isNull()).drop(
        "relieving_date"
    )


@query(
    "read_grid_order",
    "SELECT user_id, min(event_id) AS event_id, count(*) AS events FROM events GROUP BY user_id",
)
def read_grid_order(spark, sf_dir):
    """First event of every user by its place in the file, which is sorted by event."""
    rows = read_grid(spark, f"{sf_dir.rstrip('/')}/events.parquet", "parquet")
    return rows.groupBy("user_id").agg(
        F.min_by("event_id", "row_order").alias("event_id"), F.count(F.lit(1)).alias("events")
    )


def write_grids(spark: SparkSession, sf_dir: str) -> str:
    """The month as three CSV files in the shared folder, each with a header of its own.

    The second has name and ID swapped and no lead; the third has one more column, comes in another
    order and starts on the second file's last day, with codes that must not win.
    """
    long = derived.attendance_month(spark, sf_dir).withColumn(
        "header", F.date_format("date", "d-MMM-yy")
    )
    parts = {
        "1": (1, 10, ["employee_id", "employee_name", "reporting_manager", "ou_name", "functional_lead", "relieving_date"]),
        "2": (11, 20, ["employee_name", "employee_id", "ou_name", "reporting_manager", "relieving_date"]),
        "3": (20, 31, ["note", "ou_name", "functional_lead", "employee_id", "reporting_manager", "employee_name", "relieving_date"]),
    }
    folder = shared_folder(spark, "grids")
    days = long.withColumn("day", F.dayofmonth("date")).withColumn("note", F.lit("P"))
    for name, (first, last, columns) in parts.items():
        again = F.when((F.col("day") == 20) & F.lit(name == "3"), F.lit("ABSENT"))
        rows = days.where(F.col("day").between(first, last)).withColumn(
            "raw_code", F.coalesce(again, "raw_code")
        )
        headers = [
            r["header"] for r in rows.select("header", "date").distinct().orderBy("date").collect()
        ]
        wide = rows.groupBy(*columns).pivot("header", headers).agg(F.first("raw_code"))
        wide.write.option("header", True).csv(f"{folder}/{name}")
    return folder


@query(
    "read_many_grids",
    with_daily(
        f"SELECT {DAILY_COLUMNS}, CAST(relieving_date AS VARCHAR) AS relieving_date,"
        f" CAST(date AS VARCHAR) AS date, code, {sql.METRICS} FROM daily",
        sql.MANY_GRIDS,
    ),
)
def read_many_grids(spark, sf_dir):
    grids = read_grids(spark, f"{write_grids(spark, sf_dir)}/*")
    return dates_as_text(analyse_grids(grids).daily)


@query(
    "relieving_dates",
    """SELECT o_orderkey, CASE WHEN (o_orderkey // 4) % 8 = 7 THEN NULL
         WHEN o_orderkey % 4 = 3 AND (o_orderkey // 4) % 8 = 4 AND day(o_orderdate) <= 12
           THEN strftime(make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)), '%Y-%m-%d')
         ELSE strftime(o_orderdate, '%Y-%m-%d') END AS relieving_date
       FROM orders""",
)
def relieving_dates(spark, sf_dir):
    """Dates in many styles. A day up to 12 that is written first is read as the month."""
    place = F.floor(F.col("o_orderkey") / 4) % 8
    odd = F.col("o_orderkey") % 4 == 3
    styles = [
        "yyyy-MM-dd", "d-MMM-yyyy", "M/d/yyyy", "yyyy-MM-dd'T'HH:mm:ss",
        "MM-dd-yyyy", "d MMMM yyyy", "MMM d, yyyy",
    ]
    written = F.when(odd & (place == 4), F.date_format("o_orderdate", "dd.MM.yyyy"))
    for number, style in enumerate(styles):
        written = written.when(place == number, F.date_format("o_orderdate", style))
    written = written.otherwise(F.lit("left early"))
    rows = derived.table(spark, sf_dir, "orders").select(
        "o_orderkey", written.alias("relieving_date")
    )
    return dates_as_text(cleaning.parse_relieving_date(rows))


@query(
    "header_dates",
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date
       FROM orders""",
)
def header_dates(spark, sf_dir):
    style = F.col("o_orderkey") % 3
    header = (
        F.when(style == 0, F.date_format("o_orderdate", "d-MMM-yy"))
        .when(style == 1, F.date_format("o_orderdate", "d-MMM-yyyy"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    )
    rows = derived.table(spark, sf_dir, "orders").select(
        "o_orderkey", dates.header_date_column(header).alias("date")
    )
    return dates_as_text(rows)


@query(
    "clean_codes",
    f"WITH {sql.MONTH},\n{sql.CLEAN} SELECT employee_id, CAST(date AS VARCHAR) AS date, code FROM clean",
)
def clean_codes(spark, sf_dir):
    rough = derived.attendance_month(spark, sf_dir).withColumn(
        "raw_code", F.concat(F.lit(" "), F.lower("raw_code"), F.lit("\t"))
    )
    return dates_as_text(cleaning.clean_days(rough).select("employee_id", "date", "code"))


@query(
    "consolidated_employees",
    f"""WITH {sql.EVENT_CODES},
halves AS (
  SELECT user_id, d, event_id % 2 AS half, min_by(code, event_id) AS code
  FROM ev GROUP BY user_id, d, event_id % 2),
present AS (SELECT DISTINCT user_id, half FROM halves),
meta AS (
  SELECT user_id, {sql.USER_COLUMNS},
    CASE WHEN max(half) = 1 THEN '2024-01-20' END AS relieving_date
  FROM present GROUP BY user_id),
firsts AS (SELECT user_id, d, min_by(code, half) AS raw_code FROM halves GROUP BY user_id, d)
SELECT employee_id, employee_name, reporting_manager, 'N/A' AS email_id, ou_name, functional_lead,
  relieving_date, CAST(d AS VARCHAR) AS date, upper(raw_code) AS code
FROM firsts JOIN meta USING (user_id)
WHERE upper(raw_code) NOT IN ('H', 'W') AND NOT regexp_matches(lower(employee_id), '123|fc|pc')""",
)
def consolidated_employees(spark, sf_dir):
    return dates_as_text(cleaning.clean_grid(derived.attendance_duplicates(spark, sf_dir)))


# --- daily metrics ----------------------------------------------------------


@query(
    "split_half_days",
    with_daily(
        "SELECT employee_id, CAST(date AS VARCHAR) AS date, code, p1 AS first_part,"
        " p2 AS second_part, w AS part_weight FROM parts WHERE contains(code, '/')"
    ),
)
def split_half_days(spark, sf_dir):
    clean = cleaning.clean_days(derived.attendance_month(spark, sf_dir))
    parts = days.split_days(clean).where(F.col("code").contains("/"))
    return dates_as_text(
        parts.select("employee_id", "date", "code", "first_part", "second_part", "part_weight")
    )


def _scored(name: str, columns: list[str], where: str, where_column):
    listed = ", ".join(columns)

    @query(
        name,
        with_daily(
            f"SELECT employee_id, CAST(date AS VARCHAR) AS date, code, {listed}"
            f" FROM daily WHERE {where}"
        ),
    )
    def scored(spark, sf_dir):
        daily = month(spark, sf_dir).daily.where(where_column())
        return dates_as_text(daily.select("employee_id", "date", "code", *columns))


_SIX = [name for name in cb.DAY_METRICS if not name.startswith("leave_")]
_scored("half_day_metrics", _SIX, "contains(code, '/')", lambda: F.col("code").contains("/"))
_scored(
    "half_day_leave", cb.LEAVE_COLUMNS, "contains(code, '/')", lambda: F.col("code").contains("/")
)
_scored("full_day_metrics", _SIX, "NOT contains(code, '/')", lambda: ~F.col("code").contains("/"))
_scored(
    "full_day_leave",
    cb.LEAVE_COLUMNS,
    "NOT contains(code, '/')",
    lambda: ~F.col("code").contains("/"),
)


@query(
    "daily_metrics",
    with_daily(
        f"SELECT {DAILY_COLUMNS}, CAST(relieving_date AS VARCHAR) AS relieving_date,"
        f" CAST(date AS VARCHAR) AS date, code, {sql.METRICS} FROM daily"
    ),
)
def daily_metrics(spark, sf_dir):
    return dates_as_text(month(spark, sf_dir).daily)


# --- employees --------------------------------------------------------------

_EMPLOYEE_SELECT = "SELECT * REPLACE (CAST(relieving_date AS VARCHAR) AS relieving_date) FROM employee"


@query("employee_totals", with_employee(_EMPLOYEE_SELECT))
def employee_totals(spark, sf_dir):
    return dates_as_text(month(spark, sf_dir).employees)


@query("employee_totals_intended", with_employee(_EMPLOYEE_SELECT, codes=sql.INTENDED_CODES))
def employee_totals_intended(spark, sf_dir):
    rows = derived.attendance_month(spark, sf_dir)
    return dates_as_text(analyse_days(rows, cb.INTENDED).employees)


@query("grid_to_employees", with_employee(_EMPLOYEE_SELECT))
def grid_to_employees(spark, sf_dir):
    return dates_as_text(analyse_grid(derived.attendance_grid(spark, sf_dir)).employees)


# --- KPIs -------------------------------------------------------------------

_KPIS = f", s AS (SELECT {sql.KPI_SUMS}, {sql.LEAVE_SUMS} FROM employee) SELECT *, {sql.KPI_RATES} FROM s"


@query("company_kpis", with_employee(_KPIS))
def company_kpis(spark, sf_dir):
    return kpis.group_kpis(month(spark, sf_dir).employees)


@query(
    "unit_kpis",
    with_employee(
        f", s AS (SELECT ou_name, {sql.KPI_SUMS}, {sql.LEAVE_SUMS} FROM employee GROUP BY ou_name)"
        f" SELECT *, {sql.KPI_RATES} FROM s"
    ),
)
def unit_kpis(spark, sf_dir):
    return kpis.group_kpis(month(spark, sf_dir).employees, "ou_name")


_LEAVE_ROWS = " UNION ALL ".join(
    f"SELECT '{name.removeprefix('leave_').upper()}' AS leave_type, sum({name}) AS days FROM employee"
    for name in sql.LEAVES
)


@query("leave_breakdown", with_employee(_LEAVE_ROWS))
def leave_breakdown(spark, sf_dir):
    return kpis.leave_breakdown(month(spark, sf_dir).employees)


@query(
    "leave_breakdown_map",
    with_employee(
        f", rows AS (SELECT reporting_manager, u.leave_type, u.days FROM ("
        "SELECT reporting_manager, "
        + ", ".join(f"sum({name}) AS {name}" for name in sql.LEAVES)
        + " FROM employee GROUP BY reporting_manager) s, LATERAL (VALUES "
        + ", ".join(f"('{n.removeprefix('leave_').upper()}', s.{n})" for n in sql.LEAVES)
        + ") AS u(leave_type, days)) SELECT reporting_manager, leave_type, days FROM rows"
    ),
)
def leave_breakdown_map(spark, sf_dir):
    """The map per manager, opened into rows to be comparable."""
    sums = month(spark, sf_dir).employees.groupBy("reporting_manager").agg(*kpis.leave_sums())
    return kpis.add_leave_map(sums).select(
        "reporting_manager", F.explode("leave_breakdown").alias("leave_type", "days")
    )


@query(
    "data_quality",
    with_employee(
        """SELECT count(*) AS total_employees_processed,
           count(*) FILTER (WHERE reporting_manager = 'N/A') AS employees_missing_manager_name,
           count(*) FILTER (WHERE mandays <= 0) AS employees_with_zero_mandays FROM employee"""
    ),
)
def data_quality(spark, sf_dir):
    return kpis.data_quality(month(spark, sf_dir).employees)


_COMPANY_MANAGERS = (
    f", s AS (SELECT 'company' AS level, NULL AS functional_lead, NULL AS reporting_manager, {sql.KPI_SUMS}"
    f" FROM employee UNION ALL SELECT 'manager', functional_lead, reporting_manager, {sql.KPI_SUMS}"
    f" FROM employee GROUP BY functional_lead, reporting_manager) SELECT *, {sql.KPI_RATES} FROM s"
)


@query("company_and_manager_kpis", with_employee(_COMPANY_MANAGERS))
def company_and_manager_kpis(spark, sf_dir):
    return kpis.company_and_manager_kpis(month(spark, sf_dir).employees)


def _managers_sql(lead: str) -> str:
    return with_employee(
        f", s AS (SELECT {lead} AS functional_lead, reporting_manager, {sql.KPI_SUMS}"
        f" FROM employee GROUP BY ALL), r AS (SELECT *, {sql.KPI_RATES} FROM s)"
        " SELECT reporting_manager AS manager_name, total_employees AS team_size, presence_rate,"
        " leave_rate, absenteeism_rate, functional_lead FROM r"
    )


@query("manager_kpis", _managers_sql("functional_lead"))
def manager_kpis(spark, sf_dir):
    return kpis.manager_kpis(month(spark, sf_dir).employees)


@query("manager_kpis_without_lead", _managers_sql("'N/A'"))
def manager_kpis_without_lead(spark, sf_dir):
    return kpis.manager_kpis(month(spark, sf_dir).employees.drop("functional_lead"))


@query(
    "manager_teams",
    with_employee("SELECT functional_lead, reporting_manager, employee_id, mandays FROM employee"),
)
def manager_teams(spark, sf_dir):
    teams = kpis.manager_teams(month(spark, sf_dir).employees)
    return teams.select("functional_lead", "reporting_manager", "employee_id", "mandays")


@query(
    "period_working_days",
    with_daily("SELECT count(DISTINCT date) AS period_working_days FROM daily"),
)
def period_working_days(spark, sf_dir):
    return kpis.period_working_days(month(spark, sf_dir).daily)


def _summary_sql(label: str, where: str) -> str:
    return with_employee(
        f", s AS (SELECT {sql.KPI_SUMS}, {sql.LEAVE_SUMS}, count(*) AS total_employees_processed,"
        " count(*) FILTER (WHERE reporting_manager = 'N/A') AS employees_missing_manager_name,"
        " count(*) FILTER (WHERE mandays <= 0) AS employees_with_zero_mandays"
        f" FROM employee WHERE {where})"
        f" SELECT '{label}' AS analysis_period, *, {sql.KPI_RATES},"
        f" (SELECT count(DISTINCT date) FROM daily WHERE {where}) AS period_max_working_days FROM s"
    )


@query("attendance_summary", _summary_sql("Analysis for: Overall", "TRUE"))
def attendance_summary(spark, sf_dir):
    return month(spark, sf_dir).summary("Overall")


@query("empty_summary", _summary_sql("No data for: Current View", "FALSE"))
def empty_summary(spark, sf_dir):
    return month(spark, sf_dir).view(units=["no such unit"]).summary("Current View")


@query(
    "baseline_company",
    with_employee(
        f", s AS (SELECT {sql.KPI_SUMS}, {sql.LEAVE_SUMS} FROM employee)"
        f" SELECT *, {sql.KPI_RATES}, 'vs. Company Avg.' AS baseline_name FROM s"
    ),
)
def baseline_company(spark, sf_dir):
    master = month(spark, sf_dir)
    return kpis.baseline_kpis(master.view(leads=["FL_1", "FL_2"]).employees, master.employees)


@query(
    "baseline_peers",
    with_employee(
        f", s AS (SELECT {sql.KPI_SUMS}, {sql.LEAVE_SUMS}, count(DISTINCT ou_name) AS units"
        " FROM employee WHERE ou_name <> 'OU_1')"
        f" SELECT * EXCLUDE (units), {sql.KPI_RATES},"
        " 'vs. Peer Avg. (' || units || ' OUs)' AS baseline_name FROM s"
    ),
)
def baseline_peers(spark, sf_dir):
    master = month(spark, sf_dir)
    return kpis.baseline_kpis(master.view(units=["OU_1"]).employees, master.employees)


_VIEW = "ou_name IN ('OU_0', 'OU_2') AND functional_lead IN ('FL_0', 'FL_1', 'FL_3')"


def _view(spark, sf_dir) -> Attendance:
    return month(spark, sf_dir).view(units=["OU_0", "OU_2"], leads=["FL_0", "FL_1", "FL_3"])


@query(
    "view_cards",
    with_employee(
        f", s AS (SELECT {sql.KPI_SUMS} FROM employee WHERE {_VIEW})"
        " SELECT total_employees, mandays, total_presence, total_leave, total_absenteeism,"
        f" {sql.percent('total_presence', 'mandays')} AS deployment_percentage, {sql.KPI_RATES} FROM s"
    ),
)
def view_cards(spark, sf_dir):
    return kpis.view_cards(_view(spark, sf_dir).employees)


@query(
    "capacity",
    with_employee(
        f""", s AS (SELECT count(*) AS headcount, sum(mandays) AS mandays,
             (SELECT count(DISTINCT date) FROM daily WHERE {_VIEW}) AS period_working_days
             FROM employee WHERE {_VIEW}),
           c AS (SELECT *, headcount * period_working_days AS standard_capacity,
             headcount * period_working_days - mandays AS capacity_gap FROM s)
           SELECT *, CASE WHEN capacity_gap > 0
             THEN 'Gap: -' || format('{{:,.1f}}', capacity_gap) || ' Days'
             ELSE 'Full Capacity' END AS capacity_flag FROM c"""
    ),
)
def capacity(spark, sf_dir):
    view = _view(spark, sf_dir)
    return kpis.capacity(view.employees, view.daily)


@query(
    "absence_cost",
    with_employee(
        "SELECT sum(total_absenteeism) AS total_absenteeism,"
        " sum(total_absenteeism) * 100.0::DOUBLE AS estimated_cost FROM employee"
    ),
)
def absence_cost(spark, sf_dir):
    return kpis.absence_cost(month(spark, sf_dir).employees)


@query(
    "team_rollup",
    with_employee(
        f""", s AS (SELECT functional_lead, reporting_manager, count(*) AS team_size,
             sum(mandays) AS mandays, sum(total_absenteeism) AS total_absenteeism
             FROM employee GROUP BY ALL),
           r AS (SELECT *, team_size * (SELECT count(DISTINCT date) FROM daily) AS standard_capacity,
             {sql.percent("total_absenteeism", "mandays")} AS absenteeism_rate FROM s)
           SELECT *, CASE WHEN absenteeism_rate > 7.0 THEN 'alert' ELSE 'ok' END AS status FROM r"""
    ),
)
def team_rollup(spark, sf_dir):
    frames = month(spark, sf_dir)
    return kpis.team_rollup(frames.employees, frames.daily)


# --- insights ---------------------------------------------------------------

_ABSENCES = """valid AS (
  SELECT * FROM daily WHERE code IN ('LWP', 'ABSENT')
    AND (relieving_date IS NULL OR date <= relieving_date)),
gaps AS (
  SELECT employee_id, employee_name, date,
    date - lag(date) OVER (PARTITION BY employee_id ORDER BY date) AS gap_days
  FROM valid),
streaks AS (
  SELECT *, CAST(sum(CASE WHEN gap_days > 3 THEN 1 ELSE 0 END)
    OVER (PARTITION BY employee_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak_id
  FROM gaps),
long_streaks AS (
  SELECT employee_id, employee_name, count(*) AS consecutive_days,
    strftime(min(date), '%Y-%m-%d') AS absence_start_date,
    strftime(max(date), '%Y-%m-%d') AS absence_end_date
  FROM streaks GROUP BY employee_id, employee_name, streak_id HAVING count(*) >= 4)"""
_PATTERNS = """totals AS (
  SELECT employee_id, count(*) AS total_leaves FROM daily
  WHERE code IN ('CL', 'SL', 'LWP', 'ABSENT') GROUP BY employee_id HAVING count(*) >= 4),
weekdays AS (
  SELECT employee_id, dayname(date) AS day_of_week, count(*) AS pattern_days FROM daily
  WHERE code IN ('CL', 'SL', 'LWP', 'ABSENT') AND dayname(date) IN ('Monday', 'Friday')
  GROUP BY ALL),
shares AS (
  SELECT employee_id, total_leaves, day_of_week, pattern_days,
    pattern_days / total_leaves * 100 AS pattern_pct
  FROM totals JOIN weekdays USING (employee_id)
  WHERE pattern_days / total_leaves * 100 >= 40)"""


@query(
    "valid_absences",
    with_daily(f", {_ABSENCES} SELECT employee_id, CAST(date AS VARCHAR) AS date, code FROM valid"),
)
def valid_absences(spark, sf_dir):
    absences = insights.valid_absences(month(spark, sf_dir).daily)
    return dates_as_text(absences.select("employee_id", "date", "code"))


@query(
    "absence_gaps",
    with_daily(
        f", {_ABSENCES} SELECT employee_id, employee_name, CAST(date AS VARCHAR) AS date,"
        " 1::BIGINT AS records, coalesce(gap_days, -1)::BIGINT AS gap_days FROM gaps"
    ),
)
def absence_gaps(spark, sf_dir):
    gaps = insights.absence_gaps(month(spark, sf_dir).daily)
    return dates_as_text(
        gaps.withColumn("gap_days", F.coalesce("gap_days", F.lit(-1)).cast("long"))
    )


@query(
    "streak_ids",
    with_daily(
        f", {_ABSENCES} SELECT employee_id, CAST(date AS VARCHAR) AS date, streak_id FROM streaks"
    ),
)
def streak_ids(spark, sf_dir):
    streaks = insights.streak_ids(month(spark, sf_dir).daily)
    return dates_as_text(streaks.select("employee_id", "date", "streak_id"))


@query("absence_streaks", with_daily(f", {_ABSENCES} SELECT * FROM long_streaks"))
def absence_streaks(spark, sf_dir):
    return insights.absence_streaks(month(spark, sf_dir).daily)


@query(
    "absence_streaks_history",
    with_daily(
        """, valid AS (SELECT employee_id, employee_name, date FROM daily WHERE code IN ('LWP', 'ABSENT')),
        gaps AS (SELECT *, date - lag(date) OVER (PARTITION BY employee_id ORDER BY date) AS gap FROM valid),
        streaks AS (SELECT *, sum(CASE WHEN gap > 3 THEN 1 ELSE 0 END)
          OVER (PARTITION BY employee_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS n FROM gaps)
        SELECT employee_id, employee_name, count(*) AS consecutive_days,
          strftime(min(date), '%Y-%m-%d') AS absence_start_date,
          strftime(max(date), '%Y-%m-%d') AS absence_end_date
        FROM streaks GROUP BY employee_id, employee_name, n HAVING count(*) >= 2""",
        rows=sql.HISTORY,
    ),
)
def absence_streaks_history(spark, sf_dir):
    """Streaks of two over years of data, where several absences share a date."""
    daily = analyse_days(derived.attendance_history(spark, sf_dir)).daily
    return insights.absence_streaks(daily, streak_threshold=2)


@query(
    "leave_day_counts",
    with_daily(
        """SELECT employee_id, count(*) AS total_leaves,
           count(*) FILTER (WHERE dayname(date) = 'Monday') AS "Monday",
           count(*) FILTER (WHERE dayname(date) = 'Friday') AS "Friday"
           FROM daily WHERE code IN ('CL', 'SL', 'LWP', 'ABSENT')
           GROUP BY employee_id HAVING count(*) >= 4"""
    ),
)
def leave_day_counts(spark, sf_dir):
    return insights.leave_day_counts(month(spark, sf_dir).daily)


@query("weekday_shares", with_daily(f", {_PATTERNS} SELECT * FROM shares"))
def weekday_shares(spark, sf_dir):
    return insights.weekday_shares(month(spark, sf_dir).daily)


@query(
    "weekday_patterns",
    with_employee(
        f", {_PATTERNS} SELECT employee_id, e.employee_name, day_of_week, total_leaves, pattern_days,"
        " pattern_pct, CAST(round_even(pattern_pct, 0) AS BIGINT) || '% of their ' || total_leaves"
        " || ' leaves were on ' || day_of_week || 's' AS description"
        " FROM shares LEFT JOIN employee e USING (employee_id)"
    ),
)
def weekday_patterns(spark, sf_dir):
    frames = month(spark, sf_dir)
    return insights.weekday_patterns(frames.daily, frames.employees)


@query(
    "briefing_facts",
    with_employee(
        f", {_ABSENCES}, {_PATTERNS}, s AS (SELECT {sql.KPI_SUMS} FROM employee)"
        f" SELECT total_employees, {sql.percent('total_presence', 'mandays')} AS deployment_percentage,"
        " total_presence AS mandays_worked, total_absenteeism AS mandays_lost,"
        " (SELECT count(*) FROM long_streaks) AS long_absences,"
        " (SELECT count(*) FROM shares) AS weekday_patterns FROM s"
    ),
)
def briefing_facts(spark, sf_dir):
    return month(spark, sf_dir).briefing()


# --- scorecard --------------------------------------------------------------

_MANAGERS = f"""managers AS (
  SELECT reporting_manager AS manager_name, count(*) AS team_size,
    {sql.percent("sum(total_absenteeism)", "sum(mandays)")} AS absenteeism_rate,
    {sql.percent("(sum(worked_weekends) + sum(worked_holidays))", "sum(total_presence)")}
      AS extra_effort_rate
  FROM employee WHERE reporting_manager <> 'N/A' GROUP BY reporting_manager),
means AS (SELECT avg(absenteeism_rate) AS aa, avg(extra_effort_rate) AS ae FROM managers),
quadrants AS (
  SELECT managers.*, aa, ae, CASE
    WHEN absenteeism_rate <= aa AND extra_effort_rate >= ae THEN 'star_performers'
    WHEN extra_effort_rate >= ae THEN 'burnout_risk'
    WHEN absenteeism_rate <= aa THEN 'stable_uninspired' ELSE 'high_risk' END AS quadrant
  FROM managers, means)"""


@query("manager_effort", with_employee(f", {_MANAGERS} SELECT * FROM managers"))
def manager_effort(spark, sf_dir):
    return scorecard.manager_effort(month(spark, sf_dir).employees)


@query(
    "manager_quadrants",
    with_employee(
        f", {_MANAGERS} SELECT manager_name, team_size, absenteeism_rate, extra_effort_rate,"
        " round(aa, 6) AS avg_absenteeism, round(ae, 6) AS avg_effort, quadrant,"
        " printf('%.1f', absenteeism_rate) || '%' AS absenteeism,"
        " printf('%.1f', extra_effort_rate) || '%' AS effort FROM quadrants"
    ),
)
def manager_quadrants(spark, sf_dir):
    table = scorecard.manager_quadrants(month(spark, sf_dir).employees).drop("managers")
    return table.withColumns(
        {name: F.round(name, 6) for name in ("avg_absenteeism", "avg_effort")}
    )


@query(
    "leadership_scorecard",
    with_employee(
        f", {_MANAGERS} SELECT CASE quadrant WHEN 'star_performers' THEN '✅ Star Performer'"
        " WHEN 'burnout_risk' THEN '🔥 Burnout Risk' WHEN 'stable_uninspired' THEN '⚖️ Stable Cluster'"
        " ELSE '🚩 High Risk' END AS status, manager_name AS manager, team_size,"
        " absenteeism_rate AS absenteeism_pct, extra_effort_rate AS extra_effort_pct FROM quadrants"
    ),
)
def leadership_scorecard(spark, sf_dir):
    return scorecard.leadership_scorecard(month(spark, sf_dir).employees)


# --- views and drill-downs --------------------------------------------------


@query(
    "cascade_filter",
    with_employee(
        "SELECT employee_id, ou_name, functional_lead, reporting_manager, mandays FROM employee"
        f" WHERE {_VIEW} AND reporting_manager IN ('MGR_0', 'MGR_3', 'MGR_6', 'N/A')"
    ),
)
def cascade_filter(spark, sf_dir):
    view = views.cascade_filter(
        month(spark, sf_dir).employees,
        units=["OU_0", "OU_2"],
        leads=["FL_0", "FL_1", "FL_3"],
        managers=["MGR_0", "MGR_3", "MGR_6", "N/A"],
    )
    return view.select("employee_id", "ou_name", "functional_lead", "reporting_manager", "mandays")


@query(
    "cascade_filter_nothing_selected",
    with_employee("SELECT count(*) AS employees FROM employee WHERE FALSE"),
)
def cascade_filter_nothing_selected(spark, sf_dir):
    view = views.cascade_filter(month(spark, sf_dir).employees, units=["OU_none"], leads=["FL_0"])
    return view.agg(F.count(F.lit(1)).alias("employees"))


@query(
    "filter_options",
    with_employee(
        "SELECT DISTINCT 'unit' AS level, ou_name AS choice FROM employee UNION ALL"
        " SELECT DISTINCT 'lead', functional_lead FROM employee WHERE ou_name = 'OU_1' UNION ALL"
        " SELECT DISTINCT 'manager', reporting_manager FROM employee"
        " WHERE ou_name = 'OU_1' AND functional_lead = 'FL_2'"
    ),
)
def filter_options(spark, sf_dir):
    everyone = month(spark, sf_dir).employees
    unit = views.cascade_filter(everyone, units=["OU_1"])
    lead = views.cascade_filter(unit, leads=["FL_2"])

    def named(level: str, frame: DataFrame, column: str) -> DataFrame:
        return views.filter_options(frame, column).select(
            F.lit(level).alias("level"), F.col(column).alias("choice")
        )

    return (
        named("unit", everyone, "ou_name")
        .unionByName(named("lead", unit, "functional_lead"))
        .unionByName(named("manager", lead, "reporting_manager"))
    )


@query(
    "daily_in_view",
    with_daily(
        f"SELECT employee_id, CAST(date AS VARCHAR) AS date, code FROM daily WHERE {_VIEW}"
    ),
)
def daily_in_view(spark, sf_dir):
    rows = views.daily_in_view(month(spark, sf_dir).daily, _view(spark, sf_dir).employees)
    return dates_as_text(rows.select("employee_id", "date", "code"))


_DRILL_CODES = {
    "presence": "'P', 'AR', 'W*', 'H*'",
    "absence": "'LWP', 'ABSENT', 'A'",
    "leave": "'BL', 'CL', 'CO', 'EL', 'ELec', 'ML', 'PL', 'PRL', 'RH', 'SL'",
}


def _drill_where(metric: str) -> str:
    codes = _DRILL_CODES[views.DRILLDOWNS[metric][0]]
    return f"list_has_any(string_split(code, '/'), [{codes}])"


@query(
    "drilldown_rows",
    with_daily(
        "SELECT employee_id, CAST(date AS VARCHAR) AS date, code FROM daily WHERE "
        + _drill_where("Absenteeism Rate")
    ),
)
def drilldown_rows(spark, sf_dir):
    rows = views.drilldown_rows(month(spark, sf_dir).daily, "Absenteeism Rate")
    return dates_as_text(rows.select("employee_id", "date", "code"))


@query(
    "drilldown_records",
    with_daily(
        "SELECT CAST(date AS VARCHAR) AS date, employee_name, reporting_manager, ou_name, code,"
        ' presence, "leave", lwp, absent FROM daily WHERE ' + _drill_where("Mandays Lost")
    ),
)
def drilldown_records(spark, sf_dir):
    return dates_as_text(views.drilldown_records(month(spark, sf_dir).daily, "Mandays Lost"))


def _drilldown(metric: str) -> None:
    name = metric.lower().replace(" ", "_")
    _, column = views.DRILLDOWNS[metric]

    @query(
        f"drilldown_codes_{name}",
        with_daily(
            f"SELECT code, count(*) AS records FROM daily WHERE {_drill_where(metric)} GROUP BY code"
        ),
    )
    def code_counts(spark, sf_dir):
        return views.drilldown_codes(month(spark, sf_dir).daily, metric)

    @query(
        f"top_contributors_{name}",
        with_employee(
            f"SELECT employee_id, employee_name, {column} FROM employee"
            f" ORDER BY {column} DESC, employee_id LIMIT 5"
        ),
    )
    def contributors(spark, sf_dir):
        return views.top_contributors(month(spark, sf_dir).employees, metric)


for _name in views.DRILLDOWNS:
    _drilldown(_name)


@query(
    "team_members",
    with_employee(
        "SELECT functional_lead, reporting_manager, employee_id AS emp_id, employee_name AS name,"
        ' total_presence AS present, total_leave AS "leave", total_absenteeism AS absent, mandays'
        " FROM employee"
    ),
)
def team_members(spark, sf_dir):
    return views.team_members(month(spark, sf_dir).employees)


# --- reports ----------------------------------------------------------------


def _two_places(column: str) -> str:
    return f"printf('%.2f', {column}) || '%'"


_SUMMARY_VALUES = {
    "total_employees": "CAST(total_employees AS VARCHAR)",
    "presence_rate": _two_places("presence_rate"),
    "leave_rate": _two_places("leave_rate"),
    "absenteeism_rate": _two_places("absenteeism_rate"),
}


@query(
    "report_summary",
    with_employee(
        f", s AS (SELECT {sql.KPI_SUMS} FROM employee), k AS (SELECT *, {sql.KPI_RATES} FROM s) "
        + " UNION ALL ".join(
            f"SELECT '{label}' AS \"Metric\","
            f" {_SUMMARY_VALUES.get(column, f'''printf('%.1f', {column})''')} AS \"Value\" FROM k"
            for label, column, _ in reports.SUMMARY_LINES
        )
    ),
)
def report_summary(spark, sf_dir):
    return reports.summary_report(kpis.group_kpis(month(spark, sf_dir).employees))


@query(
    "report_detail",
    with_employee(
        """SELECT employee_id AS "Employee_ID", employee_name AS "Employee_Name", ou_name AS "OU_Name",
           functional_lead AS "Functional_Lead", reporting_manager AS "Reporting_Manager",
           total_presence AS presence_days, total_leave AS leave_days,
           total_absenteeism AS absenteeism_days, mandays AS total_mandays, deployment_percentage,
           CASE WHEN mandays > 0 THEN round_even(total_presence / mandays * 100 * 100, 0) / 100
             ELSE 0.0 END AS presence_percentage,
           CASE WHEN mandays > 0 THEN round_even(total_absenteeism / mandays * 100 * 100, 0) / 100
             ELSE 0.0 END AS absenteeism_percentage,
           worked_weekends, worked_holidays,
           printf('%.1f (Present) + %.1f (Leave) + %.1f (Absent) = %.1f Mandays',
             total_presence, total_leave, total_absenteeism, mandays) AS calculation_breakdown, """
        + ", ".join(sorted(sql.LEAVES))
        + " FROM employee"
    ),
)
def report_detail(spark, sf_dir):
    return reports.detail_report(month(spark, sf_dir).employees)
