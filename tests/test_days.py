import pytest

from musterline.functions.codes import AS_OBSERVED, DAY_METRICS, INTENDED, LEAVE_COLUMNS
from musterline.plans.attendance import analyse_days


def score(days_of, code, book=AS_OBSERVED):
    row = analyse_days(days_of([("E1", "2024-01-02", code)]), book).daily.first()
    return {name: row[name] for name in DAY_METRICS if row[name]}


@pytest.mark.parametrize(
    "code, expected",
    [
        ("P", {"presence": 1.0}),
        ("ar", {"presence": 1.0}),
        ("W*", {"presence": 1.0, "worked_weekends": 1.0}),
        ("H*", {"presence": 1.0, "worked_holidays": 1.0}),
        ("CL", {"leave": 1.0, "leave_cl": 1.0}),
        ("EL", {"leave": 1.0}),
        ("PL", {"leave": 1.0}),
        ("ELec", {}),
        ("LWP", {"lwp": 1.0}),
        ("ABSENT", {"absent": 1.0}),
        ("A", {}),
        ("ZZ", {}),
        ("CL/SL", {"leave": 1.0, "leave_cl": 0.5, "leave_sl": 0.5}),
        ("CL/CL", {"leave": 1.0, "leave_cl": 1.0}),
        ("P / W*", {"presence": 1.0, "worked_weekends": 0.5}),
        ("W/P", {"presence": 0.5}),
        ("P/ABSENT", {"presence": 0.5, "absent": 0.5}),
        ("CL/SL/EL", {"leave": 0.5, "leave_cl": 0.5}),
        ("LWP/", {"lwp": 0.5}),
    ],
)
def test_code_weights(days_of, code, expected):
    assert score(days_of, code) == expected


def test_intended_reading(days_of):
    assert score(days_of, "ELec", INTENDED) == {"leave": 1.0, "leave_elec": 1.0}
    assert score(days_of, "A", INTENDED) == {"absent": 1.0}
    assert score(days_of, "A/P", INTENDED) == {"absent": 0.5, "presence": 0.5}


def test_breakdown_may_be_below_total_leave(days_of):
    row = analyse_days(days_of([("E1", "2024-01-02", "EL"), ("E1", "2024-01-03", "CL")])).employees.first()
    assert row.total_leave == 2.0
    assert sum(row[name] for name in LEAVE_COLUMNS) == 1.0


def test_employee_balance(days_of):
    rows = [("E1", f"2024-01-{d:02d}", c) for d, c in enumerate(["P", "P/CL", "LWP", "ABSENT", "A"], 1)]
    row = analyse_days(days_of(rows)).employees.first()
    assert (row.total_presence, row.total_leave, row.total_absenteeism) == (1.5, 0.5, 2.0)
    assert row.mandays == 4.0
    assert row.deployment_percentage == 37.5


def test_deployment_rounds_half_to_even(days_of):
    # 1 of 16 days is 6.25, 1 of 32 days 3.125: two places give 3.12.
    rows = [("E1", f"2024-01-{d:02d}", "P" if d == 1 else "CL") for d in range(1, 32)]
    rows.append(("E1", "2024-02-01", "CL"))
    assert analyse_days(days_of(rows)).employees.first().deployment_percentage == 3.12


def test_only_days_off_leave_no_employee_and_unknown_codes_zero_mandays(days_of):
    frames = analyse_days(
        days_of([("E1", "2024-01-01", "H"), ("E1", "2024-01-02", "W"), ("E2", "2024-01-01", "ZZ")])
    )
    rows = frames.employees.collect()
    assert [r.employee_id for r in rows] == ["E2"]
    assert rows[0].mandays == 0.0 and rows[0].deployment_percentage == 0.0


def test_rows_score_on_their_own(spark, days_of, tmp_path):
    """Cleaning and scoring of long rows hold no state, so they run on a stream as they are."""
    days_of([("E1", "2024-01-02", "P/CL"), ("E1", "2024-01-03", "H")]).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    running = (
        analyse_days(stream)
        .daily.writeStream.format("memory")
        .queryName("scored_days")
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination(60)
    assert spark.table("scored_days").collect() == analyse_days(batch).daily.collect()
