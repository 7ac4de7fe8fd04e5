"""Bounded samples of labelled texts for fitting classifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from musterline.llm.common import remainder


def agreed(labels: DataFrame, label: str, folds: int, held_out: int) -> DataFrame:
    """(doc_id, label) outside the held-out fold, each id once; see `labelled` for what is left out."""
    return (
        labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
        .where(remainder(F.col("doc_id"), folds) != held_out)
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("most"))
        .where("label = most")
        .drop("most")
    )


def labelled(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    folds: int,
    held_out: int,
    most_rows: int,
    most_chars: int,
    more: Sequence[str] = (),
) -> list[tuple]:
    """At most `most_rows` (text, label, *more) rows per class outside the held-out fold.

    Rows are chosen by a hash of doc_id, so every run takes the same. Ids with labels
    that disagree, null ids, null labels and null texts are left out, and so are texts over
    `most_chars`, which bounds what reaches the driver by 2 * most_rows * most_chars.
    """
    ids = agreed(labels, label, folds, held_out)
    chosen = None
    for value in (0, 1):
        part = (
            ids.where(F.col("label") == value)
            .orderBy(F.xxhash64("doc_id"), "doc_id")
            .limit(most_rows)
        )
        chosen = part if chosen is None else chosen.unionAll(part)
    texts = docs.select("doc_id", F.struct("text", *more).alias("content")).where(
        F.col("text").isNotNull() & (F.length("text") <= most_chars)
    )
    # At most 2 * most_rows ids are broadcast. Copies of an id count once.
    rows = (
        texts.join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "label")
        .agg(F.min("content").alias("content"))
        .collect()
    )
    return [
        (row["content"]["text"], row["label"], *(row["content"][name] for name in more))
        for row in sorted(rows, key=lambda r: r["doc_id"])
    ]


def class_weights(ids: DataFrame, sampled: Sequence[int]) -> tuple[float, float]:
    """What a sampled row of class 0 and of class 1 stands for, so that the true shares hold.

    `ids` are the rows of `agreed`, all counted; `sampled` are the labels of the sample.
    """
    totals = {row["label"]: row["count"] for row in ids.groupBy("label").count().collect()}
    return tuple(
        max(1.0, totals.get(value, 0) / max(1, sum(label == value for label in sampled)))
        for value in (0, 1)
    )
