"""Status codes -> daily metrics. All operators here work row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from musterline.functions.codes import AS_OBSERVED, CodeBook
from musterline.functions.columns import sql_list, strip


def split_days(days: DataFrame) -> DataFrame:
    """Add `first_part`, `second_part` and `part_weight`.

    A code with a slash is two half days, cut at the first slash; the rest of
    the code stays in the second part. Any other code is one full day.
    """
    code = F.col("code")
    halves = F.split(code, "/", 2)
    is_split = code.contains("/")
    return days.withColumns(
        {
            "first_part": F.when(is_split, strip(halves[0])).otherwise(code),
            "second_part": F.when(is_split, strip(halves[1])),
            "part_weight": F.when(is_split, F.lit(0.5)).otherwise(F.lit(1.0)),
        }
    )


def score_days(days: DataFrame, book: CodeBook = AS_OBSERVED) -> DataFrame:
    """Add the daily metrics: each part of a day counts with its weight."""
    metrics = [f"{_weight(codes)} AS `{name}`" for name, codes in book.day_metrics().items()]
    kept = [f"`{name}`" for name in days.columns]
    return split_days(days).selectExpr(*kept, *metrics)


def _weight(codes: tuple[str, ...]) -> str:
    wanted = sql_list(codes)
    return (
        f"CASE WHEN first_part IN ({wanted}) THEN part_weight ELSE 0D END"
        f" + CASE WHEN second_part IN ({wanted}) THEN part_weight ELSE 0D END"
    )
