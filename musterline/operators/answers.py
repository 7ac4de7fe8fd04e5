"""The answers of each leaver as one map by question.

Which questions there are depends on the data, so as columns they have to be found first. As a
map they need not: feedback, comments and proof are expressions on it, and only a sink
turns questions into columns (`leavers.pivot_answers`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from musterline.functions.columns import strip
from musterline.operators.leavers import (
    COMMENT_MARKS,
    IDENTIFIERS,
    QUESTION,
    first_answers,
    question_column,
    usable_answers,
)


def gather_answers(answers: DataFrame, order: Column | str | None = None) -> DataFrame:
    """One row per leaver: the identifiers and `answers`, question -> first non-null answer.

    First answers are picked on the map side, so a leaver holds at most one per question.
    """
    entry = F.struct(F.col(QUESTION).cast("string"), "answer")
    return first_answers(answers, order).groupBy(*IDENTIFIERS).agg(
        F.map_from_entries(F.collect_list(entry)).alias("answers")
    )


def questions(answers: DataFrame) -> Column:
    """All questions in order, as a one-row subquery: a questionnaire bounds them."""
    asked = usable_answers(answers).agg(
        F.array_sort(F.collect_set(F.col(QUESTION).cast("string"))).alias("asked")
    )
    return asked.scalar()


def add_feedback(gathered: DataFrame, asked: Column) -> DataFrame:
    """`full_feedback`: identifiers that are text, then the answers, null as empty.

    A leaver answers few of all questions: only those given are placed, the others are the
    blanks between them."""
    kinds = dict(gathered.dtypes)
    known = [F.coalesce(name, F.lit("")) for name in IDENTIFIERS if kinds[name] == "string"]
    said = _bound(F.col("asked"), lambda q: _bound(_placed(q), lambda p: _spaced(p, q)))
    # Every answer follows a blank; without identifiers the first one does not.
    text = F.concat(F.array_join(F.array(*known), " "), said) if known else F.substr(said, F.lit(2))
    return gathered.withColumn("asked", asked).withColumn("full_feedback", text).drop("asked")


def _bound(value: Column, then) -> Column:
    """`then(value)`, with the value formed once."""
    return F.transform(F.array(value), then)[0]


def _placed(questions: Column) -> Column:
    """The answers with the places of their questions, in order."""
    placed = F.transform(
        F.map_entries("answers"),
        lambda e: F.struct(
            F.array_position(questions, e["key"]).cast("int").alias("place"),
            F.coalesce(e["value"], F.lit("")).alias("answer"),
        ),
    )
    return F.array_sort(F.filter(placed, lambda e: e["place"] > 0))


def _spaced(placed: Column, questions: Column) -> Column:
    """One text of all answers, each after a blank."""
    place = lambda number: F.coalesce(F.get(placed, number)["place"], F.lit(0))
    blanks = lambda before, at: F.repeat(F.lit(" "), at - before)
    answers = F.transform(placed, lambda e, i: F.concat(blanks(place(i - 1), e["place"]), e["answer"]))
    last = blanks(place(F.size(placed) - 1), F.size(questions))
    return F.concat(F.array_join(answers, ""), last)


def is_comment(question: Column) -> Column:
    """Questions that ask for free text, by the name they would have as a column."""
    name = question_column(question)
    marked = F.lit(False)
    for mark in COMMENT_MARKS:
        marked = marked | name.contains(mark)
    return marked


def _comments() -> Column:
    """The answers to such questions, in the order of the questions."""
    entries = F.array_sort(F.map_entries("answers"))
    return F.filter(entries, lambda e: is_comment(e["key"]))


def verbatim_comments(gathered: DataFrame) -> DataFrame:
    """Adds `all_comments`, joined by `". "`; leavers without one are left out."""
    said = F.filter(
        _comments(), lambda e: (strip(e["value"]) != "") & (F.length(e["value"]) > 1)
    )
    return gathered.withColumn(
        "all_comments", F.array_join(F.transform(said, lambda e: e["value"]), ". ")
    ).where(F.col("all_comments") != "")


def proof(gathered: DataFrame, *keep: str) -> DataFrame:
    """One row per leaver and comment: `keep`, designation, reason, sentiment, question, answer."""
    return gathered.select(
        *keep,
        "designation",
        "resignationreason",
        "sentiment",
        F.inline(
            F.transform(
                _comments(),
                lambda e: F.struct(
                    question_column(e["key"]).alias("question"), e["value"].alias("answer")
                ),
            )
        ),
    )
