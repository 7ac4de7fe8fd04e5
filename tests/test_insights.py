import random

import pandas as pd

from musterline.operators import insights
from musterline.plans.attendance import analyse_days


def streaks(days_of, rows, least=4):
    daily = analyse_days(days_of(rows)).daily
    return [
        (r.employee_id, r.consecutive_days, r.absence_start_date, r.absence_end_date)
        for r in insights.absence_streaks(daily, least).collect()
    ]


def days(employee, numbers, code="ABSENT", **own):
    return [(employee, f"2024-01-{n:02d}", code, own) for n in numbers]


def test_gap_of_three_days_keeps_a_streak_and_four_ends_it(days_of):
    assert streaks(days_of, days("E1", [1, 2, 5, 8])) == [("E1", 4, "2024-01-01", "2024-01-08")]
    assert streaks(days_of, days("E1", [1, 2, 6, 7])) == []


def test_presence_inside_and_half_days_do_not_matter(days_of):
    rows = days("E1", [1, 2, 5]) + days("E1", [3], "P") + days("E1", [4], "LWP/P") + days("E1", [6], "LWP")
    assert streaks(days_of, rows) == [("E1", 4, "2024-01-01", "2024-01-06")]


def test_absence_after_relieving_is_ignored(days_of):
    rows = days("E1", [1, 2, 3, 4, 5, 6], relieving="2024-01-04")
    assert streaks(days_of, rows) == [("E1", 4, "2024-01-01", "2024-01-04")]


def test_undated_rows_join_the_last_streak(days_of):
    rows = days("E1", [1, 2, 3]) + [("E1", None, "LWP")]
    assert streaks(days_of, rows) == [("E1", 4, "2024-01-01", "2024-01-03")]
    assert streaks(days_of, days("E2", [1, 2, 3], relieving="2024-02-01") + [("E2", None, "LWP", {"relieving": "2024-02-01"})]) == []


def test_repeated_dates_count_as_rows(days_of):
    assert streaks(days_of, days("E1", [1, 1, 2, 2])) == [("E1", 4, "2024-01-01", "2024-01-02")]


def test_longest_first(days_of):
    rows = days("E1", [1, 2, 3, 4]) + days("E2", [1, 2, 3, 4, 5])
    assert [s[1] for s in streaks(days_of, rows)] == [5, 4]


def test_streaks_against_a_loop(days_of):
    draw = random.Random(7)
    rows = []
    for employee in ("E1", "E2", "E4", "E5"):
        rows += days(employee, sorted(draw.choices(range(1, 32), k=draw.randint(5, 25))))
    expected = []
    for employee, group in pd.DataFrame([r[:2] for r in rows]).groupby(0):
        found, last = [], None
        for date in sorted(pd.to_datetime(group[1])):
            if last is None or (date - last).days > 3:
                found.append([])
            found[-1].append(date)
            last = date
        expected += [
            (employee, len(s), f"{s[0]:%Y-%m-%d}", f"{s[-1]:%Y-%m-%d}") for s in found if len(s) >= 2
        ]
    assert sorted(streaks(days_of, rows, 2)) == sorted(expected)


def test_weekday_patterns(days_of):
    # 2024-01-01, 08, 15 are Mondays; 05 is a Friday.
    rows = days("E1", [1, 8, 15], "CL") + days("E1", [5, 3], "SL") + days("E2", [1, 8, 15], "CL")
    frames = analyse_days(days_of(rows))
    found = insights.weekday_patterns(frames.daily, frames.employees).collect()
    assert [(r.employee_id, r.day_of_week, r.pattern_days) for r in found] == [("E1", "Monday", 3)]
    assert found[0].description == "60% of their 5 leaves were on Mondays"


def test_weekday_share_rounds_half_to_even(days_of):
    rows = days("E1", [1, 8, 15, 22, 29], "CL") + days("E1", [2, 3, 4], "CL")
    frames = analyse_days(days_of(rows))
    row = insights.weekday_patterns(frames.daily, frames.employees).first()
    assert row.pattern_pct == 62.5 and row.description.startswith("62% of their 8 leaves")


def test_names_come_from_the_employees_in_view(days_of):
    frames = analyse_days(days_of(days("E1", [1, 8, 15, 22], "CL")))
    row = insights.weekday_patterns(frames.daily, frames.employees.where("false")).first()
    assert row.employee_name is None and row.pattern_pct == 100.0
