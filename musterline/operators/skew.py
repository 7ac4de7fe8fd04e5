"""Joins and groups that stay even when one key holds a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

# A key is hot when it holds more than this share of all rows. There can be at
# most SHARES such keys whatever the data, so their list is safe to broadcast.
SHARES = 10_000


def hot_keys(
    counts: DataFrame, keys: Sequence[str], rows: str, least: int, shares: int = SHARES
) -> DataFrame:
    """Keys with many rows and the number of `splits` each needs.

    `counts` has one row per key with its row count in `rows`. No split holds
    more than about `max(least, total / shares)` rows, and the result has at most
    `shares` rows with at most `2 * shares` splits in all.
    """
    limit = F.greatest(
        counts.agg((F.coalesce(F.sum(rows), F.lit(0)) / shares).alias("n")).scalar(),
        F.lit(float(least)),
    )
    return counts.where(F.col(rows) > limit).select(
        *keys, F.ceil(F.col(rows) / limit).cast("int").alias("splits")
    )


def add_split(
    frame: DataFrame, hot: DataFrame, keys: Sequence[str], spread: str, name: str = "split"
) -> DataFrame:
    """Number the splits of the many-rows side; `hot` comes from `hot_keys`.

    The number is a hash of `spread`, so a retried task computes it again. Rows of
    keys that are not hot are in split 0. `splits` says how many the key has.
    """
    return frame.join(F.broadcast(hot), list(keys), "left").withColumns(
        {
            "splits": F.coalesce("splits", F.lit(1)),
            name: F.pmod(F.xxhash64(spread), F.coalesce("splits", F.lit(1))).cast("int"),
        }
    )


def copy_per_split(
    frame: DataFrame, hot: DataFrame, keys: Sequence[str], name: str = "split"
) -> DataFrame:
    """Repeat the one-row-per-key side once for every split of a hot key."""
    numbers = F.sequence(F.lit(0), F.coalesce("splits", F.lit(1)) - 1)
    return (
        frame.join(F.broadcast(hot), list(keys), "left")
        .withColumn(name, F.explode(numbers))
        .drop("splits")
    )
