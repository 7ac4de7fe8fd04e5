import pytest
from pyspark.sql import functions as F

from musterline.functions.codes import LEAVE_COLUMNS
from musterline.operators import insights, kpis
from musterline.plans.attendance import analyse_days


@pytest.fixture(scope="module")
def frames(days_of):
    people = {
        "E1": {"manager": "M1", "unit": "U1", "lead": "F1"},
        "E2": {"manager": "M1", "unit": "U1", "lead": "F1"},
        "E3": {"manager": "M2", "unit": "U2", "lead": "F1"},
        "E4": {"manager": None, "unit": "U3", "lead": "F2"},
        "E5": {"manager": "M3", "unit": "U3", "lead": "F2"},
    }
    codes = {
        "E1": ["P", "P", "CL", "LWP"],
        "E2": ["W*", "P", "P", "P/SL"],
        "E3": ["ABSENT", "P", "H*", "BL"],
        "E4": ["P", "P", "P", "P"],
        "E5": ["ZZ"],
    }
    rows = [
        (who, f"2024-01-{day:02d}", code, people[who])
        for who, list_ in codes.items()
        for day, code in enumerate(list_, 1)
    ]
    return analyse_days(days_of(rows))


def test_company_kpis(frames):
    row = kpis.group_kpis(frames.employees).first()
    assert row.total_employees == 5
    assert (row.total_presence, row.total_leave, row.total_absenteeism) == (11.5, 2.5, 2.0)
    assert row.mandays == 16.0
    assert row.presence_rate + row.leave_rate + row.absenteeism_rate == pytest.approx(100)
    assert row.total_extra_work_days == 2.0


def test_managers_add_up_to_the_company(frames):
    rows = kpis.company_and_manager_kpis(frames.employees).collect()
    company = [r for r in rows if r.level == "company"]
    managers = [r for r in rows if r.level == "manager"]
    assert len(company) == 1 and len(managers) == 4
    for name in ("total_employees", "mandays", "total_presence", "total_absenteeism"):
        assert sum(r[name] for r in managers) == company[0][name]
    assert company[0].functional_lead is None


def test_managers_without_a_lead_column(frames):
    rows = kpis.manager_kpis(frames.employees.drop("functional_lead")).collect()
    assert {r.functional_lead for r in rows} == {"N/A"}
    assert {r.manager_name: r.team_size for r in rows} == {"M1": 2, "M2": 1, "N/A": 1, "M3": 1}


def test_data_quality(frames):
    assert tuple(kpis.data_quality(frames.employees).first()) == (5, 1, 1)


def test_leave_breakdown_and_map(frames):
    rows = {r.leave_type: r.days for r in kpis.leave_breakdown(frames.employees).collect()}
    assert rows == {"BL": 1.0, "CL": 1.0, "CO": 0.0, "ELEC": 0.0, "ML": 0.0, "PRL": 0.0, "RH": 0.0, "SL": 0.5}
    folded = kpis.add_leave_map(kpis.group_kpis(frames.employees)).first()
    assert folded.leave_breakdown == rows


def test_every_employee_is_a_row_of_the_managers_team(frames):
    teams = kpis.manager_teams(frames.employees)
    assert teams.count() == frames.employees.count()
    assert teams.columns[:3] == ["functional_lead", "reporting_manager", "employee_id"]



def test_working_days(frames, days_of):
    assert kpis.period_working_days(frames.daily).first()[0] == 4
    undated = analyse_days(days_of([("E1", None, "P"), ("E1", "2024-01-01", "P")])).daily
    assert kpis.period_working_days(undated).first()[0] == 1


def test_summary_of_nobody_is_zero(frames):
    row = frames.view(managers=[]).summary("Current View").first()
    assert row.analysis_period == "No data for: Current View"
    assert row.total_employees == 0 and row.presence_rate == 0.0 and row.mandays == 0.0
    assert row.period_max_working_days == 0
    assert frames.summary("May").first().analysis_period == "Analysis for: May"


def test_baseline_for_one_unit_is_the_other_units(frames):
    row = kpis.baseline_kpis(frames.view(units=["U1"]).employees, frames.employees).first()
    assert row.baseline_name == "vs. Peer Avg. (2 OUs)"
    assert row.total_employees == 3 and row.mandays == 8.0


def test_baseline_otherwise_is_the_company(frames):
    several = kpis.baseline_kpis(frames.view(units=["U1", "U2"]).employees, frames.employees).first()
    assert several.baseline_name == "vs. Company Avg." and several.total_employees == 5
    alone = frames.view(units=["U1"])
    single = kpis.baseline_kpis(alone.employees, alone.employees).first()
    assert single.baseline_name == "vs. Company Avg." and single.total_employees == 2


def test_baseline_of_an_empty_view_is_zero(frames):
    row = kpis.baseline_kpis(frames.view(units=[]).employees, frames.employees).first()
    assert row.total_employees == 0 and row.baseline_name is None


def test_capacity_and_its_flag(frames):
    row = kpis.capacity(frames.employees, frames.daily).first()
    assert (row.headcount, row.period_working_days, row.standard_capacity) == (5, 4, 20)
    assert row.capacity_gap == 4.0 and row.capacity_flag == "Gap: -4.0 Days"
    full = frames.view(units=["U1"])
    assert kpis.capacity(full.employees, full.daily).first().capacity_flag == "Full Capacity"


def test_absence_cost(frames):
    assert kpis.absence_cost(frames.employees).first().estimated_cost == 200.0
    assert kpis.absence_cost(frames.employees, 250).first().estimated_cost == 500.0


def test_team_rollup_flags_high_absenteeism(frames):
    rows = {r.reporting_manager: r for r in kpis.team_rollup(frames.employees, frames.daily).collect()}
    assert rows["M1"].status == "alert" and rows["N/A"].status == "ok"
    assert rows["M1"].standard_capacity == 8


def test_briefing_counts(frames):
    row = frames.briefing().first()
    assert row.long_absences == insights.absence_streaks(frames.daily).count()
    assert row.mandays_lost == 2.0


def test_every_metric_is_a_multiple_of_a_half(frames):
    sums = frames.employees.select(*[(F.col(c) * 2 % 1).alias(c) for c in LEAVE_COLUMNS])
    assert all(v == 0 for row in sums.collect() for v in row)


def test_day_sets_count_distinct_days_of_any_union(spark, days_of):
    from musterline.operators import day_sets, views

    rows = [("E1", "2026-01-31", "P"), ("E1", "2026-01-31", "CL"), ("E1", None, "P"), ("E1", "2026-02-01", "P")]
    other = [("E2", "2026-01-31", "P"), ("E2", "2026-01-01", "P"), ("E2", "2025-01-31", "P")]
    daily = analyse_days(days_of(rows, unit="U1", lead="L1")).daily.unionByName(
        analyse_days(days_of(other, unit="U2", lead="L1")).daily
    )
    sets = day_sets.day_sets(daily)
    assert day_sets.working_days(sets).first().working_days == 4
    assert {r.ou_name: r.working_days for r in day_sets.working_days(sets, "ou_name").collect()} == {"U1": 2, "U2": 3}
    one = views.cascade_filter(sets, units=["U1"])
    assert day_sets.working_days(one).first().working_days == 2
    assert day_sets.working_days(sets.limit(0)).first().working_days == 0
    assert kpis.period_working_days(daily.limit(0)).first().period_working_days == 0
    plan = kpis.period_working_days(daily)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
