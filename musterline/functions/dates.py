"""Reading dates from grid headers and relieving-date cells."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, functions as F

# What a date header looks like, and its format.
DATE_HEADER = re.compile(r"\d{1,2}-[A-Za-z]{3}-\d{2,4}")
HEADER_FORMAT = "%d-%b-%y"

# Formats tried in turn for relieving dates. Where day and month can be told
# apart by nothing but their order, the month comes first.
DATE_FORMATS = (
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "d-MMM-yy",
    "d-MMM-yyyy",
    "M/d/yyyy",
    "yyyy/M/d",
    "d MMM yyyy",
    "yyyyMMdd",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "d MMMM yyyy",
    "d-MMMM-yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "M-d-yyyy",
    "M.d.yyyy",
    "d/M/yyyy",
    "d-M-yyyy",
    "d.M.yyyy",
)


def is_date_header(name: str) -> bool:
    """Prefix match, so `1-Jan-26 (Thu)` counts as a date column too."""
    return DATE_HEADER.match(str(name)) is not None


def header_date(name: str) -> dt.date | None:
    """Date of one header; a header in another format has none."""
    try:
        return dt.datetime.strptime(str(name), HEADER_FORMAT).date()
    except ValueError:
        return None


def header_date_column(header: Column) -> Column:
    """Column form of `header_date`: two-digit years 69-99 mean 1969-1999."""
    parsed = F.when(
        header.rlike(r"^\d{1,2}-[A-Za-z]{3}-\d{2}$"),
        F.try_to_date(header, "d-MMM-yy"),
    )
    return F.when(F.year(parsed) >= 2069, F.add_months(parsed, -1200)).otherwise(parsed)


def parse_date(value: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """First format that fits wins; no fit gives null."""
    return F.coalesce(*[_try_format(value, fmt) for fmt in formats])


def _try_format(value: Column, fmt: str) -> Column:
    parsed = F.try_to_date(value, fmt)
    if "yy" in fmt and "yyyy" not in fmt:
        return F.when(F.year(parsed) >= 2069, F.add_months(parsed, -1200)).otherwise(parsed)
    return parsed
