"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from musterline.llm.common import kept


def _state(links: DataFrame) -> tuple[int, int]:
    row = links.agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("mark")
    ).first()
    return row["n"], row["mark"] or 0


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour."""
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return (
        both.where("b > a")
        .join(least, "a")
        .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """Every node's smaller neighbours and itself are linked to the least of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).unionAll(moved).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, root) for every node `a` that is not the least of its component.

    `links` has the columns a and b with b < a. Alternating star steps shorten all paths; a
    component becomes a star around its least node after a logarithmic number of rounds.
    A node with many links is never gathered: its least neighbour is a minimum, taken
    before the shuffle, and its links are joined to that one row. Each round is written to
    the shared folder, so lost executors cost one round at most.
    """
    links = kept(links)
    before = _state(links)
    for _ in range(most_rounds):
        links = kept(_small_star(_large_star(links)))
        after = _state(links)
        if after == before:
            return links.select("a", F.col("b").alias("root"))
        before = after
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
