import pytest

from musterline.operators import trends
from musterline.plans.attendance import analyse_days


def months(days_of, shares, lead="FL1"):
    """Ten days a month, as many absences as named."""
    rows = []
    for month, absences in shares.items():
        for day in range(1, 11):
            code = "ABSENT" if day <= absences else "P"
            rows.append(("E1", f"{month}-{day:02d}", code, {"lead": lead}))
    return rows


def test_monthly_rates_leave_out_undated_rows(days_of):
    rows = months(days_of, {"2024-01": 2, "2024-02": 0}) + [("E1", None, "P")]
    found = trends.monthly_trends(analyse_days(days_of(rows)).daily).collect()
    assert [r.month for r in found] == ["2024-01", "2024-02"]
    assert found[0].absenteeism_rate == 20.0 and found[0].display_month == "Jan 2024"
    assert found[0].days_in_data == 10 and found[1].presence_rate == 100.0


def test_series_need_two_months(days_of):
    one = trends.monthly_trends(analyse_days(days_of(months(days_of, {"2024-01": 1}))).daily)
    two = trends.monthly_trends(
        analyse_days(days_of(months(days_of, {"2024-01": 1, "2024-02": 1}))).daily
    )
    assert trends.trend_series(one).count() == 0
    assert trends.trend_series(two).count() == 6


@pytest.mark.parametrize(
    "shares, alerts",
    [
        ({"2024-01": 1, "2024-02": 9}, 0),
        ({"2024-01": 1, "2024-02": 1, "2024-03": 2}, 1),
        ({"2024-01": 1, "2024-02": 1, "2024-03": 1}, 0),
        ({"2024-01": 0, "2024-02": 4, "2024-03": 4}, 0),
        ({"2024-01": 1, "2024-02": 2, "2024-03": 1, "2024-04": 9}, 1),
    ],
)
def test_latest_month_against_history(days_of, shares, alerts):
    monthly = trends.monthly_trends(analyse_days(days_of(months(days_of, shares))).daily)
    assert trends.absence_alert(monthly).count() == alerts


def test_alert_text(days_of):
    shares = {"2024-01": 1, "2024-02": 2, "2024-03": 1, "2024-04": 9}
    monthly = trends.monthly_trends(analyse_days(days_of(months(days_of, shares))).daily)
    row = trends.absence_alert(monthly).first()
    assert row.alert == (
        "**Strategic Alert:** Absenteeism for **Apr 2024 at 90.0%** is significantly higher than the"
        " historical average of 13.3%. This represents a **575% increase**, warranting investigation."
    )


def heat(days_of, rows, metric):
    frames = analyse_days(days_of(rows))
    grouped = trends.grouped_trends(frames.daily)
    return trends.heatmap(grouped, frames.employees, metric).collect()


def test_heatmap_trend_and_order(days_of):
    rows = (
        months(days_of, {"2024-01": 5, "2024-02": 1}, "better")
        + [(f"X{r[0]}", *r[1:]) for r in months(days_of, {"2024-01": 1, "2024-02": 5}, "worse")]
        + [(f"Y{r[0]}", *r[1:]) for r in months(days_of, {"2024-01": 1, "2024-02": 1}, "same")]
    )
    lost = heat(days_of, rows, "Absenteeism Rate")
    assert {r.functional_lead: r.trend for r in lost} == {
        "better": "Improving",
        "worse": "Worsening",
        "same": "Stable",
    }
    assert lost[-1].functional_lead == "same"
    present = heat(days_of, rows, "Presence Rate")
    assert {r.functional_lead: r.trend for r in present}["better"] == "Improving"
    assert present[0].overall_avg <= present[-1].overall_avg
    assert [r.overall_avg for r in heat(days_of, rows, "% Deployment")] == [r.overall_avg for r in present]


def test_heatmap_fills_missing_months_with_zero(days_of):
    rows = months(days_of, {"2024-01": 0, "2024-02": 0}, "both") + [
        ("E9", "2024-02-01", "P", {"lead": "late"})
    ]
    found = {r.functional_lead: r for r in heat(days_of, rows, "% Deployment")}
    assert found["late"]["2024-01"] == 0.0 and found["late"].trend == "Improving"


def test_one_month_is_stable_and_unknown_metrics_fail(days_of):
    assert heat(days_of, months(days_of, {"2024-01": 3}), "% Deployment")[0].trend == "Stable"
    with pytest.raises(ValueError, match="heatmap metric"):
        heat(days_of, months(days_of, {"2024-01": 3}), "Mood")
