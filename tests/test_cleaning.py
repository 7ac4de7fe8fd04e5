import datetime as dt

import pytest
from pyspark.sql import functions as F

from musterline.functions import dates
from musterline.functions.codes import METADATA_COLUMNS
from musterline.operators import cleaning
from musterline.plans.attendance import analyse_grid


def grid(spark, headers, rows):
    return spark.createDataFrame(rows, ", ".join(f"`{h}` string" for h in headers))


def test_headers_match_loosely(spark):
    frame = grid(
        spark, [" Employee  ID ", "EMPLOYEE_name", "Reporting Manager", "1-Jan-26"], [("E1", "a", "m", "P")]
    )
    named = cleaning.standardise_headers(frame)
    assert named.columns == ["employee_id", "employee_name", "reporting_manager", "1-Jan-26"]


def test_two_headers_with_one_meaning_are_an_error(spark):
    frame = grid(spark, ["Employee ID", "employee_id ", "1-Jan-26"], [("E1", "E1", "P")])
    with pytest.raises(ValueError, match="employee_id"):
        cleaning.standardise_headers(frame)


def test_required_columns(spark):
    with pytest.raises(ValueError, match="employee ID"):
        cleaning.check_grid(grid(spark, ["Name", "1-Jan-26"], [("a", "P")]))
    with pytest.raises(ValueError, match="date column"):
        cleaning.check_grid(grid(spark, ["employee_id", "2026-01-01 00:00:00"], [("a", "P")]))


def test_date_headers_match_by_prefix(spark):
    names = ["1-Jan-26", "01-Jan-2026", "1-Jan-26 (Thu)", "2026-01-01 00:00:00", "Jan-26", "x1-Jan-26"]
    assert [n for n in names if dates.is_date_header(n)] == names[:3]


def test_header_dates_and_century():
    assert dates.header_date("1-Jan-26") == dt.date(2026, 1, 1)
    assert dates.header_date("15-Mar-70") == dt.date(1970, 3, 15)
    assert dates.header_date("15-Mar-68") == dt.date(2068, 3, 15)
    assert dates.header_date("1-Jan-2026") is None
    assert dates.header_date("1-Jan-26 (Thu)") is None


def test_header_date_column_agrees_with_the_driver_form(spark):
    names = ["1-Jan-26", "15-Mar-70", "29-Feb-72", "15-Mar-68", "31-Feb-24", "1-Jan-2026", "1-Jan-26 (Thu)"]
    frame = spark.createDataFrame([(n,) for n in names], "h string")
    found = frame.select("h", dates.header_date_column(F.col("h")).alias("d")).collect()
    assert {r.h: r.d for r in found} == {n: dates.header_date(n) for n in names}


def test_ids_are_trimmed_and_excluded_by_part(spark):
    frame = grid(
        spark, ["employee_id"], [("E1",), (" E2\t",), (None,), ("X123",), ("E00123",), ("FC9",), ("apc",)]
    )
    assert [r[0] for r in cleaning.keep_employees(frame).collect()] == ["E1", "E2"]
    everyone = cleaning.keep_employees(frame, excluded=())
    assert everyone.count() == 6


def test_missing_metadata_is_added_and_filled(spark):
    frame = grid(spark, ["employee_id", "employee_name"], [("E1", None)])
    row = cleaning.fill_metadata(cleaning.add_missing_metadata(frame)).first()
    assert row.employee_name == row.reporting_manager == row.ou_name == "N/A"
    assert row.relieving_date is None


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2024-01-20", dt.date(2024, 1, 20)),
        ("2024-01-20 00:00:00", dt.date(2024, 1, 20)),
        ("5-Feb-24", dt.date(2024, 2, 5)),
        ("5-Feb-2024", dt.date(2024, 2, 5)),
        ("2/5/2024", dt.date(2024, 2, 5)),
        ("soon", None),
        (None, None),
    ],
)
def test_relieving_dates(spark, text, expected):
    frame = spark.createDataFrame([(text,)], "relieving_date string")
    assert cleaning.parse_relieving_date(frame).first()[0] == expected


def test_duplicates_keep_the_first_value_of_each_column(spark):
    frame = spark.createDataFrame(
        [
            ("E1", "Ann", None, None, "CL", 1),
            ("E1", "Anna", "2024-05-01", "P", "SL", 2),
            ("E2", "Bob", None, "P", None, 3),
            ("E1", "Zoe", "2024-06-01", "AR", "P", 4),
        ],
        "employee_id string, employee_name string, relieving_date string, `1-Jan-26` string,"
        " `2-Jan-26` string, place int",
    )
    rows = cleaning.clean_grid(frame.repartition(3), order="place")
    found = {(r.employee_id, r.date.day): (r.employee_name, r.code, r.relieving_date) for r in rows.collect()}
    assert found == {
        ("E1", 1): ("Ann", "P", dt.date(2024, 5, 1)),
        ("E1", 2): ("Ann", "CL", dt.date(2024, 5, 1)),
        ("E2", 1): ("Bob", "P", None),
    }


def test_day_off_in_the_first_duplicate_hides_the_second(spark):
    frame = spark.createDataFrame(
        [("E1", "H", 1), ("E1", "P", 2)], "employee_id string, `1-Jan-26` string, place int"
    )
    assert cleaning.clean_grid(frame, order="place").count() == 0


def test_unreadable_header_keeps_its_rows_without_a_date(spark):
    frame = grid(spark, ["employee_id", "1-Jan-2026", "2-Jan-26"], [("E1", "P", "P")])
    rows = cleaning.clean_grid(frame)
    assert sorted(str(r.date) for r in rows.collect()) == ["2026-01-02", "None"]
    frames = analyse_grid(frame)
    assert frames.employees.first().total_presence == 2.0
    assert frames.summary().first().period_max_working_days == 1


def test_codes_are_cleaned_and_days_off_removed(spark):
    frame = grid(
        spark,
        ["employee_id"] + [f"{d}-Jan-26" for d in range(1, 7)],
        [("E1", " p ", "h", "W", "W/P", None, "w*")],
    )
    codes = sorted(r.code for r in cleaning.clean_grid(frame).collect())
    assert codes == ["P", "W*", "W/P"]


def test_one_grid_row_per_id_needs_no_consolidation(spark):
    frame = grid(spark, ["employee_id", "1-Jan-26", "2-Jan-26"], [("E1", "P", "CL"), ("E2", "A", None)])
    quick = cleaning.clean_grid(frame, consolidate=False)
    full = cleaning.clean_grid(frame)
    assert sorted(map(str, quick.collect())) == sorted(map(str, full.collect()))
    assert quick.columns == [*METADATA_COLUMNS, "date", "code"]


def test_totals_after_consolidation_need_one_shuffle(spark):
    frame = grid(spark, ["employee_id", "1-Jan-26", "2-Jan-26"], [("E1", "P", "CL")])
    plan = analyse_grid(frame).employees._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
