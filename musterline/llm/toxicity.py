"""Toxicity: a convolutional classifier with thresholds calibrated by language.

The model (see `toxicity_net`) is trained in numpy on a bounded labelled sample; scoring is
one pass of Arrow batches over all rows, without a shuffle. The score never sees language,
source or id. A language only chooses the threshold at which a document is rejected.

Thresholds rest on all labelled rows outside the held-out fold that the net was not fitted on:
they are scored in Spark and counted by language and score step, so what reaches the driver is
at most `STEPS` rows a language. The counts of all languages together give the common
threshold. They also enter each language's own counts with the weight of `LEAN_ROWS` rows of
the rarer class: a language moves from the common threshold to its own as its labels grow.

Defined cases: null and empty texts score as a text with no words; a null or unseen language
takes the common threshold; repeated rows score alike; a sample that lacks a class gives the
constant score 0, so nothing is rejected; if the rows the net was not fitted on lack a class, all
thresholds are `COMMON`; a null id is of no fold; an empty table gives an empty result; extra
columns, whatever their names, pass through `reject`.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from musterline.llm import toxicity_net as net
from musterline.llm.common import by_value, remainder, send, whole_rows
from musterline.llm.samples import agreed, class_weights, labelled

# Rows of each class that may reach the driver, and the longest text among them.
SAMPLE_ROWS = 3_000
SAMPLE_CHARS = 65_536
# All languages enter the counts of one with the weight of so many rows of the rarer class.
LEAN_ROWS = 30
# Steps of the score in which calibration rows are counted.
STEPS = 1000
COMMON = 0.3

by_value(sys.modules[__name__], net)


@dataclass
class ToxicityModel:
    net: net.Net | None
    thresholds: dict[str, float] = field(default_factory=dict)
    common: float = COMMON


def threshold(counts: np.ndarray) -> float:
    """The cut with the best F1, in the middle of its gap, held between 0.1 and 0.7.

    `counts` has the clean and the toxic rows of every score step.
    """
    filled = np.flatnonzero(counts.sum(1))
    # Rows at or above each filled step.
    above = counts[filled][::-1].cumsum(0)[::-1]
    f1 = 2 * above[:, 1] / (above.sum(1) + above[0, 1])
    # The highest of equally good cuts.
    best = len(f1) - 1 - int(f1[::-1].argmax())
    below = filled[best - 1] + 1 if best else 0
    return float(np.clip((filled[best] + below) / 2 / STEPS, 0.1, 0.7))


def thresholds(counts: dict[str | None, np.ndarray]) -> tuple[float, dict[str, float]]:
    """The common threshold and that of each language, from the counts by language."""
    every = sum(counts.values(), np.zeros((STEPS, 2)))
    if every.sum(0).min() == 0:
        return COMMON, {}
    lean = every * (LEAN_ROWS / every.sum(0).min())
    return threshold(every), {
        language: threshold(own + lean)
        for language, own in sorted((k, v) for k, v in counts.items() if k is not None)
    }


def fit_rows(
    rows: list[tuple[str, int]], stands_for: tuple[float, float] = (1.0, 1.0)
) -> tuple[ToxicityModel, np.ndarray]:
    """Train on four fifths of the rows and calibrate the score on the rest.

    `stands_for` weights the calibration rows of class 0 and 1, for the true shares. The second value says which rows the net was fitted on.
    """
    labels = np.array([label for _, label in rows], float)
    if len(rows) < 10 or labels.min() == labels.max():
        return ToxicityModel(None), np.zeros(len(rows), bool)
    documents = [net.buckets_of(text) for text, _ in rows]
    held = np.arange(len(rows)) % 5 == 4
    if labels[held].min() == labels[held].max() or labels[~held].min() == labels[~held].max():
        held[:] = False
    fitted = net.fit([d for d, h in zip(documents, held) if not h], labels[~held])
    check = held if held.any() else ~held
    raw = net.raw_of(fitted, fitted.table(), (d for d, c in zip(documents, check) if c))
    fitted.scale, fitted.shift = net.platt(raw, labels[check], stands_for=stands_for)
    return ToxicityModel(fitted), ~held


def calibration(
    docs: DataFrame, ids: DataFrame, model: ToxicityModel, fitted: list
) -> dict[str | None, np.ndarray]:
    """Clean and toxic rows by language and score step, of the `ids` that are not in `fitted`.

    `ids` has doc_id and label. The rows of a class are weighted so that they stand for all
    of that class in `ids`. Texts are scored where they lie; only narrow rows are joined.
    """
    spark = docs.sparkSession
    known = spark.createDataFrame([(i,) for i in fitted], docs.select("doc_id").schema)
    # As many ids as the net was fitted on, at most the sample.
    marked = ids.join(
        F.broadcast(known.withColumn("fitted", F.lit(True))), "doc_id", "left"
    ).withColumn("free", F.col("fitted").isNull())
    step = F.least(F.floor(score_of(docs, model) * STEPS), F.lit(STEPS - 1)).cast("int")
    scored = docs.where(F.col("text").isNotNull()).select("doc_id", "lang", step.alias("step"))

    def rows(label: int, free: bool) -> Column:
        return F.count_if((F.col("label") == label) & (F.col("free") == free))

    # Copies of an id count once.
    found = (
        scored.join(marked, "doc_id")
        .groupBy("doc_id", "label", "free")
        .agg(F.min(F.struct("step", "lang")).alias("one"))
        .groupBy("one.lang", "one.step")
        .agg(
            F.array(rows(0, True), rows(1, True)).alias("free"),
            F.array(rows(0, False), rows(1, False)).alias("fitted"),
        )
        .collect()
    )
    free = np.array([r["free"] for r in found], float).reshape(-1, 2)
    seen = np.array([r["fitted"] for r in found], float).reshape(-1, 2).sum(0)
    weights = 1 + seen / np.maximum(free.sum(0), 1)
    counts: dict[str | None, np.ndarray] = {}
    for row, own in zip(found, free):
        held = counts.setdefault(row["lang"], np.zeros((STEPS, 2)))
        held[row["step"]] += own * weights
    return counts


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    folds: int = 4,
    held_out: int = 2,
    sample_rows: int = SAMPLE_ROWS,
) -> ToxicityModel:
    """Train on at most `sample_rows` labelled texts per class, none of the held-out fold.

    Thresholds are set on all other labelled texts outside that fold.
    """
    rows = labelled(
        docs, labels, label, folds, held_out, sample_rows, SAMPLE_CHARS, ["doc_id"]
    )
    ids = agreed(labels, label, folds, held_out)
    stands_for = class_weights(ids, [value for _, value, _ in rows])
    model, used = fit_rows([(text, value) for text, value, _ in rows], stands_for)
    if model.net is None:
        return model
    fitted = [row[2] for row, u in zip(rows, used) if u]
    own = docs.where(remainder(F.col("doc_id"), folds) != held_out)
    model.common, model.thresholds = thresholds(calibration(own, ids, model, fitted))
    return model


def score_of(docs: DataFrame, model: ToxicityModel, text: str = "text") -> Column:
    """The score of a text column: 0 to 1, higher for likelier toxic."""
    if model.net is None:
        return F.lit(0.0)
    shared = send(docs.sparkSession, (model.net, model.net.table()))

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fitted, table = pickle.loads(shared.value)
        for batch in batches:
            yield pd.Series(net.scores_of(fitted, table, batch.tolist()))

    return scored(F.col(text))


def threshold_of(model: ToxicityModel, language: Column) -> Column:
    """The threshold for a language; there are as many as languages with labels."""
    if not model.thresholds:
        return F.lit(model.common)
    pairs = [F.lit(x) for pair in model.thresholds.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[language], F.lit(model.common))


def reject(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of `docs` that are not rejected, with their own columns."""
    marked = whole_rows(docs, lang="lang", score=score_of(docs, model))
    kept = marked.where(F.col("score") < threshold_of(model, F.col("lang")))
    return kept.select("row.*")
