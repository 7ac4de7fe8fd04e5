import pytest
from pyspark.sql import functions as F

from musterline.operators import kpis, scorecard, views
from musterline.plans.attendance import analyse_days
from musterline.sinks import reports


@pytest.fixture(scope="module")
def frames(days_of):
    codes = {
        ("E1", "star"): ["W*", "P", "P", "P"],
        ("E2", "burnout"): ["H*", "P", "ABSENT", "ABSENT"],
        ("E3", "stable"): ["P", "P", "P", "CL"],
        ("E4", "risk"): ["P", "LWP", "LWP", "A"],
        ("E5", "N/A"): ["ABSENT", "A", "P/LWP", "EL"],
    }
    rows = [
        (who, f"2024-01-{d:02d}", code, {"manager": manager, "unit": f"U{int(who[1]) % 2}"})
        for (who, manager), list_ in codes.items()
        for d, code in enumerate(list_, 1)
    ]
    return analyse_days(days_of(rows))


def test_every_manager_has_one_quadrant(frames):
    rows = scorecard.manager_quadrants(frames.employees).collect()
    assert {r.manager_name: r.quadrant for r in rows} == {
        "star": "star_performers",
        "burnout": "burnout_risk",
        "stable": "stable_uninspired",
        "risk": "high_risk",
    }
    assert {r.manager_name: r.absenteeism for r in rows}["burnout"] == "50.0%"


def test_scorecard_order_and_single_manager(frames):
    card = scorecard.leadership_scorecard(frames.employees).collect()
    rates = [r.absenteeism_pct for r in card]
    assert rates == sorted(rates, reverse=True) and len(card) == 4
    assert card[0].status == "🚩 High Risk"
    assert scorecard.leadership_scorecard(frames.view(managers=["star"]).employees).count() == 0


def test_cascade(frames):
    assert frames.view(units=["U1"], managers=["star", "burnout"]).employees.count() == 1
    assert frames.view(units=["U1"], managers=[]).employees.count() == 0
    assert frames.view(leads=["nobody"]).daily.count() == 0
    assert frames.view().employees.count() == 5
    assert [r[0] for r in views.filter_options(frames.employees, "ou_name").collect()] == ["U0", "U1"]


def test_selection_on_daily_rows_equals_the_semi_join(frames):
    view = frames.view(units=["U0"])
    joined = views.daily_in_view(frames.daily, view.employees)
    assert sorted(map(str, joined.select(view.daily.columns).collect())) == sorted(map(str, view.daily.collect()))


def test_drilldown_splits_everywhere_and_lists_plain_a(frames, days_of):
    rows = {r.code: r.records for r in views.drilldown_codes(frames.daily, "Mandays Lost").collect()}
    assert rows == {"ABSENT": 3, "LWP": 2, "A": 2, "P/LWP": 1}
    odd = analyse_days(days_of([("E1", "2024-01-01", "P/X/CL"), ("E1", "2024-01-02", "P / CL")])).daily
    assert [r.code for r in views.drilldown_rows(odd, "Leave Rate").collect()] == ["P/X/CL"]


def test_records_and_top(frames):
    records = views.drilldown_records(frames.daily, "Deployment").collect()
    assert records == sorted(records, key=lambda r: (r.date, r.employee_name))
    top = views.top_contributors(frames.employees, "Absenteeism Rate", most=2).collect()
    assert [(r.employee_id, r.total_absenteeism) for r in top] == [("E2", 2.0), ("E4", 2.0)]
    with pytest.raises(ValueError, match="drill-down"):
        views.drilldown_rows(frames.daily, "Mood")


def test_member_table(frames):
    row = views.team_members(frames.employees).where("emp_id = 'E5'").first()
    assert (row.present, row.leave, row.absent, row.mandays) == (0.5, 1.0, 1.5, 3.0)


def test_summary_sheet(frames):
    rows = reports.summary_report(kpis.group_kpis(frames.employees)).collect()
    assert [r.Metric for r in rows][0] == "Total Employees in View" and len(rows) == 9
    values = {r.Metric: r.Value for r in rows}
    assert values["Total Employees in View"] == "5"
    assert values["Overall Presence %"] == "58.33%"
    assert values["Total Mandays (Denominator)"] == "18.0"


def test_detail_sheet(frames):
    sheet = reports.detail_report(frames.employees)
    assert sheet.columns.count("leave_days") == 1
    assert sheet.columns[-8:] == sorted(sheet.columns[-8:])
    row = sheet.where("Employee_ID = 'E5'").first()
    assert row.calculation_breakdown == "0.5 (Present) + 1.0 (Leave) + 1.5 (Absent) = 3.0 Mandays"
    assert row.presence_percentage == 16.67 and row.absenteeism_percentage == 50.0


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_reports_are_written_whole(spark, frames, tmp_path, fmt):
    path = str(tmp_path / fmt)
    sheet = reports.detail_report(frames.employees)
    reports.write_report(sheet, path, fmt)
    back = spark.read.option("header", True).csv(path) if fmt == "csv" else spark.read.parquet(path)
    assert back.columns == sheet.columns and back.count() == 5
    with pytest.raises(ValueError, match="unknown format"):
        reports.write_report(sheet, path, "xls")


def test_daily_rows_are_stored_by_month(spark, frames, tmp_path):
    reports.write_daily(frames.daily, str(tmp_path / "daily"))
    assert (tmp_path / "daily" / "month=2024-01").is_dir()
    back = spark.read.parquet(str(tmp_path / "daily"))
    assert back.count() == frames.daily.count()
    plan = back.where("month = '2024-01'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_a_rerun_of_one_month_leaves_the_others(spark, tmp_path, days_of):
    import glob
    import os

    path = str(tmp_path / "daily")
    first = analyse_days(days_of([("E1", "2026-01-05", "P"), ("E1", "2026-02-05", "P"), ("E2", "2026-03-05", "P")])).daily
    reports.write_daily(first, path)
    others = {f: os.path.getmtime(f) for f in glob.glob(f"{path}/month=*/*.parquet") if "2026-02" not in f}
    # The corrected month: one row less of E1, two of E3; it is formed from the folder itself.
    more = analyse_days(days_of([("E3", "2026-02-06", "CL"), ("E3", "2026-02-07", "P")])).daily
    kept_rows = spark.read.parquet(path).drop("month").where("date >= '2026-02-01' AND date < '2026-03-01' AND employee_id <> 'E1'")
    reports.replace_months(kept_rows.unionByName(more), path)
    after = spark.read.parquet(path)
    assert sorted((r.employee_id, str(r.date)) for r in after.collect()) == [
        ("E1", "2026-01-05"), ("E2", "2026-03-05"), ("E3", "2026-02-06"), ("E3", "2026-02-07")
    ]
    assert {f: os.path.getmtime(f) for f in others} == others
    # No rows: nothing is replaced. A failure while rows are formed: nothing either.
    reports.replace_months(more.limit(0), path)
    with pytest.raises(Exception, match="broken"):
        reports.replace_months(more.withColumn("code", F.raise_error(F.lit("broken")).cast("string")), path)
    assert spark.read.parquet(path).count() == 4
