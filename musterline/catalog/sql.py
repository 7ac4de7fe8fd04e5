"""Common table expressions from which the oracle SQL is put together."""

from __future__ import annotations

METRIC_CODES = {
    "presence": "'P','AR','W*','H*'",
    "leave": "'BL','CL','CO','EL','ELec','ML','PL','PRL','RH','SL'",
    "lwp": "'LWP'",
    "absent": "'ABSENT'",
    "worked_weekends": "'W*'",
    "worked_holidays": "'H*'",
    "leave_cl": "'CL'",
    "leave_sl": "'SL'",
    "leave_prl": "'PRL'",
    "leave_bl": "'BL'",
    "leave_ml": "'ML'",
    "leave_rh": "'RH'",
    "leave_elec": "'ELec'",
    "leave_co": "'CO'",
}
INTENDED_CODES = {
    **METRIC_CODES,
    "leave": "'BL','CL','CO','EL','ELEC','ML','PL','PRL','RH','SL'",
    "absent": "'ABSENT','A'",
    "leave_elec": "'ELEC'",
}
LEAVES = [name for name in METRIC_CODES if name.startswith("leave_")]
METRICS = ", ".join(METRIC_CODES)

EVENT_CODES = """ev AS (
  SELECT user_id, event_id, CAST(ts AS DATE) AS d,
    CASE event_type
      WHEN 'click' THEN CASE event_id % 7 WHEN 0 THEN 'W*' WHEN 1 THEN 'H*' WHEN 2 THEN 'AR' ELSE 'P' END
      WHEN 'view' THEN CASE event_id % 5 WHEN 0 THEN 'W' WHEN 1 THEN 'H' ELSE 'P' END
      WHEN 'purchase' THEN CASE event_id % 6 WHEN 0 THEN 'CL' WHEN 1 THEN 'EL' WHEN 2 THEN 'PL'
        WHEN 3 THEN 'ML' WHEN 4 THEN 'PRL' ELSE 'BL' END
      WHEN 'signup' THEN CASE event_id % 4 WHEN 0 THEN 'SL' WHEN 1 THEN 'ELec' WHEN 2 THEN 'RH' ELSE 'CO' END
      ELSE CASE event_id % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'LWP' ELSE 'ABSENT' END
    END AS code
  FROM events)"""

USER_COLUMNS = """concat('E', lpad(CAST(user_id AS VARCHAR), 5, '0')) AS employee_id,
    concat('Emp ', CAST(user_id AS VARCHAR)) AS employee_name,
    CASE WHEN user_id % 17 = 0 THEN 'N/A' ELSE concat('MGR_', CAST(user_id % 12 AS VARCHAR)) END AS reporting_manager,
    concat('OU_', CAST(user_id % 3 AS VARCHAR)) AS ou_name,
    concat('FL_', CAST(user_id % 5 AS VARCHAR)) AS functional_lead"""

MONTH = f"""{EVENT_CODES},
ud AS (
  SELECT user_id, d, min_by(code, event_id) AS c1, max_by(code, event_id) AS c2
  FROM ev GROUP BY user_id, d),
month_rows AS (
  SELECT {USER_COLUMNS},
    CASE WHEN user_id % 20 = 0 THEN DATE '2024-01-20' END AS relieving_date,
    d AS date,
    CASE WHEN user_id % 3 = 0 AND c1 <> c2 THEN concat(c1, '/', c2) ELSE c1 END AS raw_code
  FROM ud)"""

# Read back from three grids of which the middle one, of days 11 to 20, has no lead.
MANY_GRIDS = MONTH.replace("month_rows AS", "one_grid AS") + """,
month_rows AS (
  SELECT * REPLACE (
    CASE WHEN bool_or(day(date) <= 10 OR day(date) >= 20) OVER (PARTITION BY employee_id)
      THEN functional_lead ELSE 'N/A' END AS functional_lead)
  FROM one_grid)"""

HISTORY = """month_rows AS (
  SELECT concat('C', CAST(o_custkey AS VARCHAR)) AS employee_id,
    c_name AS employee_name, c_mktsegment AS ou_name,
    r_name AS functional_lead, n_name AS reporting_manager,
    CAST(NULL AS DATE) AS relieving_date,
    CAST(o_orderdate AS DATE) AS date,
    CASE o_orderpriority
      WHEN '1-URGENT' THEN 'ABSENT' WHEN '2-HIGH' THEN 'CL' WHEN '3-MEDIUM' THEN 'P/SL'
      WHEN '4-NOT SPECIFIED' THEN 'P'
      ELSE CASE WHEN o_orderkey % 6 = 0 THEN 'LWP' ELSE 'P' END
    END AS raw_code
  FROM orders
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""

CLEAN = """clean AS (
  SELECT trim(employee_id) AS employee_id, employee_name, reporting_manager,
    'N/A' AS email_id, ou_name, functional_lead, relieving_date, date,
    upper(trim(raw_code)) AS code
  FROM month_rows
  WHERE employee_id IS NOT NULL AND raw_code IS NOT NULL
    AND NOT regexp_matches(lower(employee_id), '123|fc|pc')
    AND upper(trim(raw_code)) NOT IN ('H', 'W'))"""


def daily(codes: dict[str, str] = METRIC_CODES) -> str:
    metrics = ",\n    ".join(
        f"w * ((CASE WHEN p1 IN ({c}) THEN 1.0 ELSE 0.0 END)"
        f" + (CASE WHEN p2 IN ({c}) THEN 1.0 ELSE 0.0 END))::DOUBLE AS {name}"
        for name, c in codes.items()
    )
    return f"""parts AS (
  SELECT *,
    CASE WHEN contains(code, '/') THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS w,
    CASE WHEN contains(code, '/') THEN trim(left(code, strpos(code, '/') - 1)) ELSE code END AS p1,
    CASE WHEN contains(code, '/') THEN trim(substr(code, strpos(code, '/') + 1)) END AS p2
  FROM clean),
daily AS (
  SELECT employee_id, employee_name, reporting_manager, email_id, ou_name, functional_lead,
    relieving_date, date, code,
    {metrics}
  FROM parts)"""


EMPLOYEE = f"""sums AS (
  SELECT employee_id, employee_name, reporting_manager, ou_name, functional_lead,
    sum(presence) AS total_presence, sum("leave") AS total_leave,
    {", ".join(f"sum({m}) AS {m}" for m in METRIC_CODES if m not in ("presence", "leave"))},
    min(relieving_date) AS relieving_date
  FROM daily GROUP BY ALL),
balance AS (
  SELECT *, lwp + absent AS total_absenteeism,
    total_presence + total_leave + (lwp + absent) AS mandays
  FROM sums),
employee AS (
  SELECT *,
    CASE WHEN mandays > 0 THEN round_even(total_presence / mandays * 100 * 100, 0) / 100
      ELSE 0.0 END AS deployment_percentage
  FROM balance)"""


def percent(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN {part} / {whole} * 100 ELSE 0.0::DOUBLE END"


KPI_SUMS = """count(*) AS total_employees,
    coalesce(sum(total_presence), 0.0::DOUBLE) AS total_presence,
    coalesce(sum(total_leave), 0.0::DOUBLE) AS total_leave,
    coalesce(sum(total_absenteeism), 0.0::DOUBLE) AS total_absenteeism,
    coalesce(sum(mandays), 0.0::DOUBLE) AS mandays,
    coalesce(sum(worked_weekends), 0.0::DOUBLE)
      + coalesce(sum(worked_holidays), 0.0::DOUBLE) AS total_extra_work_days"""
KPI_RATES = f"""{percent("total_presence", "mandays")} AS presence_rate,
    {percent("total_leave", "mandays")} AS leave_rate,
    {percent("total_absenteeism", "mandays")} AS absenteeism_rate"""
LEAVE_SUMS = ", ".join(f"coalesce(sum({m}), 0.0::DOUBLE) AS {m}" for m in LEAVES)


def with_daily(select: str, rows: str = MONTH, codes: dict[str, str] = METRIC_CODES) -> str:
    return f"WITH {rows},\n{CLEAN},\n{daily(codes)}\n{select}"


def with_employee(select: str, rows: str = MONTH, codes: dict[str, str] = METRIC_CODES) -> str:
    """`select` may start with more CTEs, each introduced by a comma."""
    return f"WITH {rows},\n{CLEAN},\n{daily(codes)},\n{EMPLOYEE}\n{select}"


ANSWERS = """k AS (
  SELECT CASE WHEN conv_id % 50 = 49 THEN conv_id - 1 ELSE conv_id END AS k,
    conv_id, turn, role, text
  FROM conversations),
answers AS (
  SELECT concat('2015-', lpad(CAST(k % 12 + 1 AS VARCHAR), 2, '0'), '-01') AS dateofjoining,
    concat('1980-01-', lpad(CAST(k % 28 + 1 AS VARCHAR), 2, '0')) AS dob,
    CASE k % 2 WHEN 0 THEN 'F' ELSE 'M' END AS gender,
    CASE k % 4 WHEN 0 THEN 'Analyst' WHEN 1 THEN 'Engineer' WHEN 2 THEN 'Lead' ELSE 'Manager' END AS designation,
    concat('R', lpad(CAST(k AS VARCHAR), 8, '0')) AS resignationletterdate,
    concat('2024-', lpad(CAST(k % 12 + 1 AS VARCHAR), 2, '0'), '-28') AS actualrelievingdate,
    CASE WHEN k % 37 = 5 THEN NULL ELSE 'Resignation' END AS separationtype,
    CASE k % 3 WHEN 0 THEN 'Pay' WHEN 1 THEN 'Growth' ELSE 'Move' END AS resignationreason,
    concat('What did the ', role, ' say (', CAST(turn AS VARCHAR), ')?') AS question_desc,
    CASE WHEN (conv_id + turn) % 9 = 0 THEN NULL ELSE text END AS choice_or_comments,
    conv_id * 1000 + turn AS row_idx
  FROM k)"""
IDENTIFIERS = (
    "dateofjoining, dob, gender, designation, resignationletterdate,"
    " actualrelievingdate, separationtype, resignationreason"
)
FIRST_ANSWERS = f"""first_answers AS (
  SELECT {IDENTIFIERS}, question_desc, min_by(choice_or_comments, row_idx) AS answer
  FROM answers
  WHERE separationtype IS NOT NULL AND question_desc IS NOT NULL
    AND choice_or_comments IS NOT NULL
  GROUP BY ALL)"""
