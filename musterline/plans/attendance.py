"""Attendance from grid to daily and employee rows, and the dashboard on top."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame

from musterline.functions.codes import AS_OBSERVED, CodeBook
from musterline.operators import (
    cleaning,
    day_sets,
    days,
    employees,
    insights,
    kpis,
    trends,
    views,
)
from musterline.session import durable


@dataclass(frozen=True)
class Attendance:
    """Lazy daily and employee rows."""

    daily: DataFrame
    employees: DataFrame

    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Attendance:
        """Keep both frames for several reports; daily rows spill to disk."""
        return Attendance(self.daily.persist(level), self.employees.persist(level))

    def unpersist(self) -> None:
        self.daily.unpersist()
        self.employees.unpersist()

    def view(
        self,
        units: Sequence[str] | None = None,
        leads: Sequence[str] | None = None,
        managers: Sequence[str] | None = None,
    ) -> Attendance:
        """The employees of a selection of units, leads and managers, and all their days.

        The days are chosen by the employee: rows under another unit of someone in view
        belong to the view.
        """
        chosen = views.cascade_filter(self.employees, units, leads, managers)
        return Attendance(views.daily_in_view(self.daily, chosen), chosen)

    def summary(self, period: str = "Overall") -> DataFrame:
        return kpis.attendance_summary(self.employees, period, self.daily)

    def day_sets(self) -> DataFrame:
        """Days with a record by unit, lead, manager and month. Small: keep it, and
        `views.cascade_filter` and `day_sets.working_days` answer for any selection."""
        return day_sets.day_sets(self.daily)

    def heatmap(self, metric: str) -> DataFrame:
        """Lead x month heatmap. The lead-month sums are few; kept, they serve both for
        finding the months and for the cells."""
        grouped = durable(trends.grouped_trends(self.daily))
        return trends.heatmap(grouped, self.employees, metric)

    def heatmap_rows(self, metric: str) -> DataFrame:
        """The heatmap with a row per lead and month, formed without finding months first."""
        return trends.heatmap_rows(trends.grouped_trends(self.daily), self.employees, metric)

    def briefing(self) -> DataFrame:
        return kpis.briefing_facts(
            self.employees,
            insights.absence_streaks(self.daily),
            insights.weekday_patterns(self.daily, self.employees),
        )


def analyse_grid(
    grid: DataFrame,
    order: Column | str | None = None,
    book: CodeBook = AS_OBSERVED,
    consolidate: bool = True,
) -> Attendance:
    """From a wide grid: clean, unpivot, score, total."""
    return _score(cleaning.clean_grid(grid, order, book, consolidate=consolidate), book)


def analyse_grids(grids: Sequence[DataFrame], book: CodeBook = AS_OBSERVED) -> Attendance:
    """From several wide grids with headers of their own, such as one per month."""
    return _score(cleaning.clean_grids(grids, book), book)


def analyse_days(rows: DataFrame, book: CodeBook = AS_OBSERVED) -> Attendance:
    """From rows that are long already: employee, `date`, `raw_code`."""
    return _score(cleaning.clean_days(rows, book), book)


def _score(clean: DataFrame, book: CodeBook) -> Attendance:
    daily = days.score_days(clean, book)
    return Attendance(daily, employees.employee_totals(daily, book))
