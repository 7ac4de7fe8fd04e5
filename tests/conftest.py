import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from musterline.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session(
        "musterline-tests",
        "local[8]",
        {
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


EMPLOYEE = (
    "employee_id string, employee_name string, reporting_manager string, email_id string,"
    " ou_name string, functional_lead string, relieving_date date"
)


@pytest.fixture(scope="session")
def days_of(spark):
    """Long attendance rows from (employee, ISO date or None, code) and the like."""

    def build(rows, manager="M1", unit="OU1", lead="FL1", relieving=None):
        data = []
        for row in rows:
            employee, date, code = row[:3]
            own = row[3] if len(row) > 3 else {}
            data.append(
                (
                    employee,
                    own.get("name", f"Name {employee}"),
                    own.get("manager", manager),
                    own.get("unit", unit),
                    own.get("lead", lead),
                    own.get("relieving", relieving),
                    date,
                    code,
                )
            )
        frame = spark.createDataFrame(
            data,
            "employee_id string, employee_name string, reporting_manager string, ou_name string,"
            " functional_lead string, relieving_date string, date string, raw_code string",
        )
        return frame.withColumn("date", frame["date"].cast("date"))

    return build
