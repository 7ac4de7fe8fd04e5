"""Small column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable
from decimal import Decimal

from pyspark.sql import Column, functions as F

# The characters that count as blank around a text.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


def strip(col: Column | str) -> Column:
    return F.btrim(_col(col), F.lit(BLANKS))


def total(name: str) -> Column:
    """Sum that is 0 on an empty group."""
    return F.expr(f"coalesce(sum(`{name}`), 0D)")


def percent(part: str, whole: str) -> Column:
    """`part / whole * 100`, 0 where `whole` is not positive."""
    return F.expr(f"CASE WHEN `{whole}` > 0 THEN `{part}` / `{whole}` * 100 ELSE 0D END")


def sql_list(values: Iterable[str]) -> str:
    """Text literals for an IN list."""
    quoted = (value.replace("\\", "\\\\").replace("'", "\\'") for value in values)
    return ", ".join(f"'{value}'" for value in quoted)


def round_half_even(col: Column | str, places: int = 2) -> Column:
    """Scale, round to the nearest even, scale back: binary floating rounding."""
    scale = float(10**places)
    return F.rint(_col(col) * scale) / scale


def fixed(col: Column | str, places: int) -> Column:
    """Text with a fixed number of decimals, at most two, of a number below 10**15.

    Rounded on the exact binary value, half to even: 1.115 is stored a little below itself
    and shows as 1.11. The fraction is counted in units of 2**-62, which hold every bit of a
    number that can lie near the middle between two texts.
    """
    value = F.abs(_col(col).cast("double"))
    whole = F.floor(value)
    unit = F.lit(Decimal(1 << 62))
    fraction = ((value - whole) * float(1 << 62)).cast("bigint").cast("decimal(19,0)")
    scaled = fraction * F.lit(Decimal(10**places))
    rest = scaled % unit
    cut = whole * 10**places + ((scaled - rest) / unit).cast("bigint")
    up = (rest * 2 > unit) | ((rest * 2 == unit) & (cut % 2 == 1))
    digits = F.lpad((cut + up.cast("bigint")).cast("string"), 20, "0")
    head = F.regexp_replace(F.substring(digits, 1, 20 - places), "^0+(?=.)", "")
    sign = F.when(_col(col) < 0, "-").otherwise("")
    tail = [F.lit("."), F.substring(digits, 21 - places, places)] if places else []
    return F.concat(sign, head, *tail)


def month_start(date: Column | str) -> Column:
    return F.trunc(_col(date), "month")


def month_key(date: Column | str) -> Column:
    return F.date_format(_col(date), "yyyy-MM")


def month_label(date: Column | str) -> Column:
    return F.date_format(_col(date), "MMM yyyy")


def day_text(date: Column | str) -> Column:
    return F.date_format(_col(date), "yyyy-MM-dd")


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value
