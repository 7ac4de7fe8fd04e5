"""Language identification of code-switched text by a conditional random field.

The field (see `language_crf`) is trained in numpy on a bounded sample of labelled documents: at
most `SAMPLE_ROWS` documents of a language and `MOST_ROWS` in all, chosen by a hash of the id,
of the `MOST_LANGUAGES` languages with the most documents, and of each document at most `RUNS`
runs of `RUN_WORDS` words spread evenly over the whole text. Labelling is one pass of Arrow
batches over all rows and whole texts, without a shuffle. A document's language is the one with
the highest mean probability over its letters, and that mean is its score.

Defined cases: null texts and texts without a letter (Unicode category L) are `und` with score 0;
equal probabilities go to the language first by code point; repeated rows are labelled alike; rows
with a null id or language are never learnt from; with one learnt language all letters are
of it; with none every text is `und`; an empty table gives an empty result; runs of over 24
letters are cut into words of 24; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from musterline.llm import language_crf as crf
from musterline.llm.common import by_value, remainder, send

SAMPLE_ROWS = 400
MOST_ROWS = 8_000
MOST_LANGUAGES = 100
# Rows that are ranked for each that is taken.
SPARE = 4
RUNS = 8
RUN_WORDS = 32
UNKNOWN = "und"

by_value(sys.modules[__name__], crf)


def runs_of(text: str | None) -> list[str]:
    """At most `RUNS` runs of words, each joined by spaces, spread over the whole text."""
    words = [
        w.lower()[:24] for w in crf.WORD.findall(text or "") if any(map(str.isalpha, w))
    ]
    if len(words) <= RUNS * RUN_WORDS:
        starts = range(0, len(words), RUN_WORDS)
    else:
        starts = [i * (len(words) - RUN_WORDS) // (RUNS - 1) for i in range(RUNS)]
    return [" ".join(words[s : s + RUN_WORDS]) for s in starts]


def sample(docs: DataFrame, folds: int, held_out: int) -> list[tuple[str, str]]:
    """(run of words, language) of the sample, in a fixed order."""
    known = docs.where(
        F.col("doc_id").isNotNull()
        & F.col("lang").isNotNull()
        & (remainder(F.col("doc_id"), folds) != held_out)
    )
    most = (
        known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    )
    languages = [row["lang"] for row in most]
    if not languages:
        return []
    rows = min(SAMPLE_ROWS, MOST_ROWS // len(languages))
    # The first rows of a language by hash. They lie in the first few hundredths of the hashes,
    # so only about `SPARE` times as many rows are shuffled and ranked.
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    shares = [F.lit(x) for r in most for x in (r["lang"], min(1.0, SPARE * rows / r["count"]))]
    reach = F.create_map(*shares)[F.col("lang")] * F.lit(float(1 << 40))
    order = W.partitionBy("lang").orderBy(place, "doc_id")
    chosen = (
        known.where(F.col("lang").isin(languages) & (place < reach))
        .select("doc_id", "lang")
        .distinct()
        .withColumn("n", F.row_number().over(order))
        .where(F.col("n") <= rows)
        .select("doc_id", "lang")
    )

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([runs_of(text) for text in batch.tolist()])

    # At most `MOST_ROWS` ids are broadcast; copies of an id count once.
    found = (
        docs.select("doc_id", "lang", "text")
        .join(F.broadcast(chosen), ["doc_id", "lang"])
        .select("doc_id", "lang", cut("text").alias("runs"))
        .groupBy("doc_id", "lang")
        .agg(F.min("runs").alias("runs"))
        .collect()
    )
    return [
        (run, row["lang"])
        for row in sorted(found, key=lambda r: (r["doc_id"], r["lang"]))
        for run in row["runs"] or []
        if run
    ]


def fit(docs: DataFrame, folds: int = 4, held_out: int = 2) -> crf.Crf | None:
    """The field, learnt from none of the held-out fold; None without labelled words."""
    rows = sample(docs, folds, held_out)
    languages = sorted({language for _, language in rows})
    if not languages:
        return None
    number = {language: n for n, language in enumerate(languages)}
    return crf.train([(run.split(" "), number[language]) for run, language in rows], languages)


def predicted(docs: DataFrame, field: crf.Crf | None, text: str = "text") -> Column:
    """struct(lang_pred, score) of a text column."""
    if field is None:
        return F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = send(docs.sparkSession, field)

    @F.pandas_udf("lang_pred string, score double")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        labeller = crf.Labeller(pickle.loads(shared.value))
        names = labeller.field.languages
        for batch in batches:
            shares = labeller.shares(batch.tolist())
            best, score = shares.argmax(1), shares.max(1)
            yield pd.DataFrame(
                {
                    "lang_pred": [names[b] if s > 0 else UNKNOWN for b, s in zip(best, score)],
                    "score": score.clip(0, 1),
                }
            )

    return label(F.col(text))


def spans(docs: DataFrame, field: crf.Crf | None, text: str = "text") -> Column:
    """array<struct<start, end, lang, score>>: stretches of one language, in characters."""
    kind = "array<struct<start:int,end:int,lang:string,score:double>>"
    if field is None:
        return F.array().cast(kind)
    shared = send(docs.sparkSession, field)

    @F.pandas_udf(kind)
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        labeller = crf.Labeller(pickle.loads(shared.value))
        names = ("start", "end", "lang", "score")
        for batch in batches:
            found = labeller.spans(batch.tolist())
            yield pd.Series([[dict(zip(names, s)) for s in own] for own in found])

    return label(F.col(text))
