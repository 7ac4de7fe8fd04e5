import pytest
from pyspark.sql import functions as F

from musterline.operators import leavers as lv
from musterline.plans.attendance import analyse_grid, analyse_grids
from musterline.sources import read_answers, read_grid, read_grids
from musterline.sources.derived import attendance_grid, exit_answers

SMALL = "/root/testdata/sf0.001"


def test_grid_from_several_csv_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "Employee ID,Employee Name,Functional Lead,1-Jan-26,2-Jan-26\n0101,Ann,Lea,P,CL/SL\n0102,Bob,,,h\n"
    )
    (tmp_path / "b.csv").write_text(
        "Employee ID,Employee Name,Functional Lead,1-Jan-26,2-Jan-26\n0102,Bobby,Lea,A,LWP\n"
    )
    grid = read_grid(spark, str(tmp_path / "*.csv"))
    rows = {r.employee_id: r for r in analyse_grid(grid).employees.collect()}
    assert set(rows) == {"0101", "0102"}
    assert rows["0102"].employee_name == "Bob" and rows["0102"].functional_lead == "N/A"
    assert rows["0101"].total_presence == 1.0 and rows["0101"].leave_sl == 0.5
    # 0102: the first file's H of 2 January wins over LWP; the A of 1 January counts nowhere.
    assert rows["0102"].mandays == 0.0


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_grid_survives_a_round_trip(spark, tmp_path, fmt):
    grid = attendance_grid(spark, SMALL)
    path = str(tmp_path / fmt)
    writer = grid.withColumnRenamed(" Employee  ID ", "EMPLOYEE ID").write
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)
    again = analyse_grid(read_grid(spark, path, fmt)).employees
    assert sorted(map(str, again.collect())) == sorted(map(str, analyse_grid(grid).employees.collect()))


def test_answers_with_line_breaks_and_quotes(spark, tmp_path):
    path = str(tmp_path / "answers")
    answers = exit_answers(spark, SMALL)
    answers.write.option("header", True).option("escape", '"').csv(path)
    back = read_answers(spark, path)
    here, there = (
        sorted(map(str, lv.pivot_answers(frame).collect())) for frame in (answers, back)
    )
    assert here == there and len(here) > 0


def test_files_keep_their_order(spark, tmp_path):
    for number, name in enumerate(["a", "b", "c"]):
        (tmp_path / f"{name}.csv").write_text(
            "Employee ID,1-Jan-26\n" + "".join(f"E{i},{name}{i}\n" for i in range(50))
        )
    rows = read_grid(spark, str(tmp_path)).orderBy("row_order").collect()
    assert [r["1-Jan-26"] for r in rows] == [f"{n}{i}" for n in "abc" for i in range(50)]


def test_bad_input_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        read_grid(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError, match="unknown format"):
        read_answers(spark, str(tmp_path), "xls")


# Months with headers of their own: one more day, name and ID swapped, a column less, one more.
MONTHS = {
    "feb [2].csv": "Employee Name,employee_id,1-Feb-26,2-Feb-26,note\nBob,0102,ABSENT,P,x\nAnn,0101,P,CL/SL,y\n",
    "jan.csv": "Employee ID,Employee Name,Functional Lead,1-Jan-26,2-Jan-26\n0101,Ann,Lea,P,P\n0102,Bob,,P,CL\n",
    "mar.csv": "Employee Name,Employee ID,Functional Lead,1-Mar-26,2-Mar-26,3-Mar-26,1-Feb-26\nAnne,0101,Lou,P,,SL,LWP\nCid,0103,Lou,P,P,P,P\n",
    "jan2.csv": "Employee ID,Employee Name,Functional Lead,1-Jan-26,2-Jan-26\n0104,Dot,Lea,CL,P\n",
    "none.csv": "",
}


def month_rows(frame):
    return sorted(
        (r.employee_id, r.employee_name, r.functional_lead, str(r.date), r.code)
        for r in frame.daily.collect()
    )


EXPECTED = sorted(
    [
        ("0101", "Ann", "Lea", "2026-01-01", "P"), ("0101", "Ann", "Lea", "2026-01-02", "P"),
        ("0102", "Bob", "N/A", "2026-01-01", "P"), ("0102", "Bob", "N/A", "2026-01-02", "CL"),
        ("0102", "Bob", "N/A", "2026-02-01", "ABSENT"), ("0102", "Bob", "N/A", "2026-02-02", "P"),
        # The cell of 1 February in the third file comes after that of the first.
        ("0101", "Ann", "Lea", "2026-02-01", "P"),
        ("0101", "Ann", "Lea", "2026-02-02", "CL/SL"),
        ("0101", "Ann", "Lea", "2026-03-01", "P"), ("0101", "Ann", "Lea", "2026-03-03", "SL"),
        ("0103", "Cid", "Lou", "2026-02-01", "P"), ("0103", "Cid", "Lou", "2026-03-01", "P"),
        ("0103", "Cid", "Lou", "2026-03-02", "P"), ("0103", "Cid", "Lou", "2026-03-03", "P"),
        ("0104", "Dot", "Lea", "2026-01-01", "CL"), ("0104", "Dot", "Lea", "2026-01-02", "P"),
    ]
)


def flat(rows):
    """Half-day cells come as two rows; here each cell is one."""
    return sorted({(i, n, lead, d, "CL/SL" if c in ("CL", "SL") and d == "2026-02-02" else c) for i, n, lead, d, c in rows})


def test_files_of_different_headers_keep_their_own_dates_and_ids(spark, tmp_path):
    for name, text in MONTHS.items():
        (tmp_path / name).write_text(text)
    grids = read_grids(spark, str(tmp_path))
    assert len(grids) == 3
    assert flat(month_rows(analyse_grids(grids))) == flat(EXPECTED)
    # One grid read with another file's header is an error, not a shift of cells.
    with pytest.raises(Exception, match="CSV header does not conform|enforceSchema|header"):
        analyse_grid(read_grid(spark, str(tmp_path))).daily.collect()


def test_parquet_files_of_different_columns(spark, tmp_path):
    # `feb [2]` sorts before `jan`, as the files do above.
    for name in ("feb [2]", "jan", "mar", "jan2"):
        lines = [line.split(",") for line in MONTHS[f"{name}.csv"].splitlines()]
        rows = [[cell or None for cell in line] for line in lines[1:]]
        frame = spark.createDataFrame(rows, ", ".join(f"`{h}` string" for h in lines[0]))
        frame.coalesce(1).write.parquet(str(tmp_path / name))
    grids = read_grids(spark, [str(tmp_path / n) for n in ("feb \\[2\\]", "jan", "mar", "jan2")], "parquet")
    assert len(grids) == 3
    assert flat(month_rows(analyse_grids(grids))) == flat(EXPECTED)


def test_one_grid_reads_alike_either_way(spark, tmp_path):
    grid = attendance_grid(spark, SMALL)
    grid.write.option("header", True).csv(str(tmp_path / "grid"))
    one = analyse_grid(read_grid(spark, str(tmp_path / "grid")))
    many = analyse_grids(read_grids(spark, str(tmp_path / "grid")))
    assert one.daily.select(sorted(one.daily.columns)).exceptAll(many.daily.select(sorted(one.daily.columns))).isEmpty()
    assert one.daily.count() == many.daily.count()


def test_grids_without_a_header_or_id_are_errors(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    with pytest.raises(ValueError, match="no file with a header"):
        read_grids(spark, str(tmp_path))
    (tmp_path / "b.csv").write_text("Name,1-Jan-26\nAnn,P\n")
    with pytest.raises(ValueError, match="no employee ID"):
        analyse_grids(read_grids(spark, str(tmp_path)))
    with pytest.raises(ValueError, match="unknown format"):
        read_grids(spark, str(tmp_path), "xls")


@pytest.fixture
def small_blocks(spark):
    """File splits of a few lines, so that quoted cells cross them."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(name) for name in names]
    for name in names:
        spark.conf.set(name, "97")
    yield
    for name, value in zip(names, before):
        spark.conf.set(name, value)


COMMENTS = [
    "plain", "", None, "a, comma", 'said ""yes""'.replace('""', '"'), "two\nlines", "\n\nblank\n",
    '"', 'odd " quote', "tail\n", "long " * 80 + "\n" * 30 + "end, \"x\" ", " spaces ", "é\nü", "1,2\n3,4", "x\r\ny",
]


def written(rows, header, end="\n"):
    def cell(value):
        if value is None:
            return ""
        return '"' + value.replace('"', '""') + '"'

    return "".join(end.join([",".join(map(cell, row)) for row in [header, *rows]]) + end)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_of_any_split_equal_the_multi_line_reader(spark, tmp_path, small_blocks, end):
    import random

    rng = random.Random(5)
    header = ["QUESTION_DESC", "a.b", "CHOICE_OR_COMMENTS"]
    for name in "ab":
        rows = [[rng.choice(COMMENTS) for _ in header] for _ in range(150)]
        # A line of nothing but empty cells is kept; blank lines are not.
        text = written(rows, header, end) + end + end + written([["last", None, 'no "end"']], header, end).split(end, 1)[1]
        (tmp_path / f"{name}.csv").write_bytes(text.rstrip("\r\n").encode())
    whole = (
        spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path))
    )
    mine = read_answers(spark, str(tmp_path))
    assert mine.rdd.getNumPartitions() > 20
    assert mine.drop("row_order").columns == whole.columns
    wanted = [tuple(r) for r in whole.orderBy("_metadata.file_path", F.monotonically_increasing_id()).collect()]
    got = [tuple(r)[:-1] for r in mine.orderBy("row_order").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, wanted)) and len(got) == 302
    # Rows of a file keep their order.
    assert got == wanted


def test_answers_with_another_header_are_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,x\n1,2\n")
    with pytest.raises(Exception, match="has the header"):
        read_answers(spark, str(tmp_path)).collect()
