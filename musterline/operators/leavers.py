"""Exit answers, one row per question -> one row per leaver."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from musterline.functions.columns import strip
from musterline.sources.files import ROW_ORDER

# The columns that identify a leaver, in output order.
IDENTIFIERS = (
    "dateofjoining",
    "dob",
    "gender",
    "designation",
    "resignationletterdate",
    "actualrelievingdate",
    "separationtype",
    "resignationreason",
)
QUESTION = "question_desc"
ANSWER = "choice_or_comments"
# Parts of a column name that mark a free-text question.
COMMENT_MARKS = ("what", "suggestion", "comment", "addtional")

LEAVER_KEY = "leaver_key"


def check_answers(answers: DataFrame) -> DataFrame:
    """Lower-case the headers; all identifiers, question and answer must be there."""
    lowered = answers.withColumnsRenamed({name: name.lower() for name in answers.columns})
    missing = [n for n in (*IDENTIFIERS, QUESTION, ANSWER) if n not in lowered.columns]
    if missing:
        raise ValueError(f"exit answers lack the columns {missing}")
    return lowered


def question_column(question: Column) -> Column:
    """Question text -> column name: blanks to `_`, other signs dropped, lower case."""
    return F.lower(
        F.regexp_replace(F.replace(question, F.lit(" "), F.lit("_")), "[^0-9a-zA-Z_]", "")
    )


def usable_answers(answers: DataFrame) -> DataFrame:
    """Rows that can reach the wide table: no null identifier, question or answer."""
    return check_answers(answers).dropna(subset=[*IDENTIFIERS, QUESTION, ANSWER])


def questions_of(answers: DataFrame) -> list[tuple[str, str]]:
    """Distinct questions with their column names, in question order.

    They become columns, so there are few. Names that clash get `_2`, `_3`, ...
    """
    rows = (
        usable_answers(answers)
        .select(F.col(QUESTION).cast("string").alias("question"))
        .distinct()
        .select("question", question_column(F.col("question")).alias("name"))
        .orderBy("question")
        .collect()
    )
    taken = set(IDENTIFIERS)
    named = []
    for row in rows:
        name, number = row["name"], 1
        while name in taken:
            number += 1
            name = f"{row['name']}_{number}"
        taken.add(name)
        named.append((row["question"], name))
    return named


def first_answers(answers: DataFrame, order: Column | str | None = None) -> DataFrame:
    """The first non-null `answer` of each leaver to each question, in input order."""
    usable = usable_answers(answers)
    if order is None:
        order = ROW_ORDER if ROW_ORDER in usable.columns else F.monotonically_increasing_id()
    order = F.col(order) if isinstance(order, str) else order
    return (
        usable.withColumn("_place", order)
        .groupBy(*IDENTIFIERS, QUESTION)
        .agg(F.min_by(F.col(ANSWER).cast("string"), "_place").alias("answer"))
    )


def pivot_answers(
    answers: DataFrame,
    order: Column | str | None = None,
    questions: Sequence[tuple[str, str]] | None = None,
) -> DataFrame:
    """One row per leaver with the first non-null answer to each question.

    `order` is the input order, by default the reader's `row_order`. The first
    answer per leaver and question is picked on the map side; only then are the
    picked answers pivoted.
    """
    questions = list(questions) if questions is not None else questions_of(answers)
    wide = (
        first_answers(answers, order)
        .groupBy(*IDENTIFIERS)
        .pivot(QUESTION, [question for question, _ in questions])
        .agg(F.first("answer"))
    )
    return wide.toDF(*IDENTIFIERS, *[name for _, name in questions])


def add_leaver_key(wide: DataFrame) -> DataFrame:
    """One text key per leaver, from the eight identifiers."""
    parts = [F.col(name).cast("string") for name in IDENTIFIERS]
    return wide.withColumn(LEAVER_KEY, F.sha2(F.to_json(F.array(*parts)), 256))


def text_columns(wide: DataFrame) -> list[str]:
    return [
        field.name
        for field in wide.schema.fields
        if field.dataType.typeName() == "string" and field.name != LEAVER_KEY
    ]


def add_feedback(wide: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """`full_feedback`: all text columns in order, joined by a space, null as empty."""
    names = list(columns) if columns is not None else text_columns(wide)
    return wide.withColumn(
        "full_feedback",
        F.concat_ws(" ", *[F.coalesce(F.col(name), F.lit("")) for name in names]),
    )


def comment_columns(wide: DataFrame) -> list[str]:
    """Columns that look like free text by their name."""
    return [name for name in wide.columns if any(mark in name for mark in COMMENT_MARKS)]


def verbatim_comments(wide: DataFrame) -> DataFrame:
    """The comments of each leaver joined by `". "`; leavers without one are left out."""
    said = [
        F.when((strip(F.col(name).cast("string")) != "") & (F.length(name) > 1), F.col(name))
        for name in comment_columns(wide)
    ]
    return wide.withColumn(
        "all_comments", F.concat_ws(". ", *said) if said else F.lit("")
    ).where(F.col("all_comments") != "")


def proof_view(wide: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Designation, reason, sentiment and the free-text columns that exist, after `keep`."""
    names = [*keep, "designation", "resignationreason", "sentiment", *comment_columns(wide)]
    return wide.select(*[name for name in names if name in wide.columns])


def designation_share(leavers: DataFrame) -> DataFrame:
    """Leavers per designation and their share of all given leavers."""
    everyone = leavers.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        leavers.groupBy("designation")
        .agg(F.count(F.lit(1)).alias("leavers"))
        .withColumn("share_pct", F.col("leavers") / everyone * 100)
        .orderBy(F.desc("leavers"), "designation")
    )


def leavers_with_theme(leavers: DataFrame, theme: str | Column) -> DataFrame:
    return leavers.where(F.array_contains("assigned_themes", theme))


def leavers_of_topic(leavers: DataFrame, corpus: str, topic: int) -> DataFrame:
    """The leavers of one topic; another topic of the same name does not count."""
    own = F.exists("assigned", lambda a: (a["corpus"] == corpus) & (a["topic"] == topic))
    return leavers.where(own)


def theme_members(leavers: DataFrame) -> DataFrame:
    """One row per topic and leaver: the leaver's columns and corpus, topic, theme."""
    return leavers.select("*", F.inline("assigned"))


def theme_designations(leavers: DataFrame) -> DataFrame:
    """Leavers by designation within every topic and their share of it."""
    counts = theme_members(leavers).groupBy("corpus", "topic", "theme", "designation").agg(
        F.count(F.lit(1)).alias("leavers")
    )
    whole = W.partitionBy("corpus", "topic")
    return counts.withColumn("share_pct", F.col("leavers") / F.sum("leavers").over(whole) * 100)
