"""The attendance vocabulary: which status code counts as what."""

from __future__ import annotations

from dataclasses import dataclass, replace

MISSING = "N/A"

# Columns that describe an employee, in output order.
TEXT_COLUMNS = (
    "employee_id",
    "employee_name",
    "reporting_manager",
    "email_id",
    "ou_name",
    "functional_lead",
)
METADATA_COLUMNS = TEXT_COLUMNS + ("relieving_date",)
EMPLOYEE_KEYS = (
    "employee_id",
    "employee_name",
    "reporting_manager",
    "ou_name",
    "functional_lead",
)


@dataclass(frozen=True)
class CodeBook:
    """Code sets as data, so that one set of operators serves every reading."""

    presence: tuple[str, ...]
    leave: tuple[str, ...]
    absence: tuple[str, ...]
    lwp: tuple[str, ...]
    absent: tuple[str, ...]
    worked_weekends: tuple[str, ...]
    worked_holidays: tuple[str, ...]
    non_working: tuple[str, ...]
    breakdown: tuple[str, ...]

    def day_metrics(self) -> dict[str, tuple[str, ...]]:
        """Metric column -> the codes that count towards it."""
        metrics = {
            "presence": self.presence,
            "leave": self.leave,
            "lwp": self.lwp,
            "absent": self.absent,
            "worked_weekends": self.worked_weekends,
            "worked_holidays": self.worked_holidays,
        }
        for code in self.breakdown:
            metrics[leave_column(code)] = (code,)
        return metrics

    def leave_columns(self) -> list[str]:
        return [leave_column(code) for code in self.breakdown]


def leave_column(code: str) -> str:
    return f"leave_{code.lower()}"


# The code sets. Codes are compared in upper case, so `ELec`
# matches nothing here, and `A` is listed as absence but counted nowhere.
AS_OBSERVED = CodeBook(
    presence=("P", "AR", "W*", "H*"),
    leave=("BL", "CL", "CO", "EL", "ELec", "ML", "PL", "PRL", "RH", "SL"),
    absence=("LWP", "ABSENT", "A"),
    lwp=("LWP",),
    absent=("ABSENT",),
    worked_weekends=("W*",),
    worked_holidays=("H*",),
    non_working=("H", "W"),
    breakdown=("CL", "SL", "PRL", "BL", "ML", "RH", "ELec", "CO"),
)

# The same sets read the way they are meant: `ELEC` is leave, `A` is absence.
INTENDED = replace(
    AS_OBSERVED,
    leave=tuple(code.upper() for code in AS_OBSERVED.leave),
    absent=("ABSENT", "A"),
    breakdown=tuple(code.upper() for code in AS_OBSERVED.breakdown),
)

LEAVE_COLUMNS = AS_OBSERVED.leave_columns()
DAY_METRICS = list(AS_OBSERVED.day_metrics())
