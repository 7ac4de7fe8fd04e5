"""Quality rules, line first, in DataFrame operations only.

Every line with a word is judged by rules of punctuation, navigation, symbols and boilerplate.
Lines that fail are removed; a document that loses too large a share of its words is rejected.
Before that stand base rules over the whole text: too few words, or too many words
inside five-word windows that occur twice or more.

Everything is computed inside the row: one scan, no shuffle. Windows are compared by 64-bit
hashes. Work per text grows as n log n.

Defined cases: null and blank texts have no words and fail the base rule; blank lines are neither
judged nor removed; repeated rows are judged alike; an empty table gives an empty result; extra
columns pass through `clean` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from musterline.llm.common import WORD, add_words

# Fixed values of the contract: symbols counted, window length, base limits.
SYMBOLS = "#*$%&|<>"
RUN = 5
LEAST_WORDS = 10
MOST_REPEATED = 20
# Percent of words that a document may lose with its failed lines.
MOST_LOST = 60
# Last characters that end a sentence, an item before a list, a quotation or a bracket.
ENDINGS = ".!?:;…。！？\"')]}”’»"
# A line fails with one boilerplate or navigation match per so many characters, begun ones
# included: one match fails a line of up to 200, a line of 201 to 400 needs two.
SHORT_LINE = 200
# White space of the word rule, taken off before the end mark is looked for.
BLANKS = " \t\n\x0b\f\r"
BOILERPLATE = (
    "all rights reserved|licensed under|released under the|under the terms of"
    "|terms of (use|service)|privacy policy|cookie policy|accept cookies|enable javascript"
    "|general public license|sign up for our newsletter|powered by"
)
NAVIGATION = (
    "^(home|menu|login|log in|sign in|register|next|previous|back to top|skip to content"
    "|share|search)\\b"
)


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def line_fails(line: Column) -> Column:
    """Whether a line fails: no end mark, shouting, a bar of links, symbols, boilerplate."""
    end = F.right(F.rtrim(line, F.lit(BLANKS)), F.lit(1))
    length = F.length(line)
    words = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    shouts = (length - F.length(F.replace(line, F.lit("!!"), F.lit("")))) / 2
    bars = (length - F.length(F.replace(line, F.lit(" | "), F.lit("")))) / 3
    symbols = length - F.length(without(line, SYMBOLS))
    # A line that runs over sentences inside is prose even if it breaks off.
    inside = F.instr(line, ". ") + F.instr(line, "? ") + F.instr(line, "! ")
    lowered = F.lower(line)
    matches = F.regexp_count(lowered, F.lit(BOILERPLATE)) + lowered.rlike(NAVIGATION).cast("int")
    return (
        ((F.instr(F.lit(ENDINGS), end) == 0) & (inside == 0))
        | (shouts * 4 >= words)
        | (bars * 4 >= words)
        | (symbols * 10 >= length)
        | (matches * SHORT_LINE >= length)
    )


def measures(docs: DataFrame) -> DataFrame:
    """Adds `figures` (base figures and what lines are left), base_failed and kept."""
    text = docs.withColumn("__text", F.coalesce("text", F.lit("")))
    worded = add_words(text, F.col("__text"), "__w")
    runs = F.transform(
        F.slice("__w", 1, F.greatest(F.size("__w") - (RUN - 1), F.lit(0))),
        lambda w, i: F.xxhash64(w, *[F.get("__w", i + k) for k in range(1, RUN)]),
    )
    lined = worded.withColumns(
        {
            "__runs": runs,
            "__lines": F.filter(F.split("__text", "\n"), lambda l: l.rlike(WORD)),
        }
    )
    # Only texts with a run found twice go on to the sorting.
    twice = F.size(F.array_distinct("__runs")) < F.size("__runs")
    sorted_runs = lined.withColumn(
        "__sorted",
        F.when(
            twice,
            F.sort_array(
                F.transform("__runs", lambda h, i: F.struct(h.alias("h"), i.alias("at")))
            ),
        ),
    )
    own = F.col("__sorted")
    found = F.transform(
        own,
        lambda r, i: F.when(
            (r["h"] == F.get(own, i + 1)["h"]) | (r["h"] == F.get(own, i - 1)["h"]), r["at"]
        ),
    )
    placed = sorted_runs.withColumn("__at", F.sort_array(F.array_compact(found)))
    # Each run found again adds the words up to the next one's start, at most its own.
    repeated = F.aggregate(
        F.transform(
            "__at",
            lambda at, i: F.least(F.coalesce(F.get("__at", i + 1) - at, F.lit(RUN)), F.lit(RUN)),
        ),
        F.lit(0).cast("long"),
        lambda total, n: total + n,
    )
    judged = placed.withColumn("__left", F.filter("__lines", lambda l: ~line_fails(l)))
    same = F.size("__lines") == F.size("__left")
    figures = F.struct(
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(without(F.col("__text"), SYMBOLS)))
        .cast("long")
        .alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(repeated, F.lit(0).cast("long")).alias("n_repeat_words"),
        (F.size("__lines") - F.size("__left")).cast("long").alias("lines_removed"),
        F.when(same, F.size("__w"))
        .otherwise(F.regexp_count(F.array_join("__left", "\n"), F.lit(WORD)))
        .cast("long")
        .alias("words_left"),
    )
    # The row number keeps the optimizer from copying these expressions into filters on the
    # figures, where they would be evaluated many times over.
    fixed = F.when(F.monotonically_increasing_id() >= 0, figures)
    verdict = judged.select(*docs.columns, fixed.alias("figures"))
    words, lost = F.col("figures.n_words"), F.col("figures.n_words") - F.col("figures.words_left")
    return verdict.withColumn(
        "base_failed",
        (words < LEAST_WORDS) | (100 * F.col("figures.n_repeat_words") > MOST_REPEATED * words),
    ).withColumn("kept", ~F.col("base_failed") & ~(100 * lost > MOST_LOST * words))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base figures, what the line rules removed, base_failed and kept."""
    return measures(docs.select("doc_id", "text")).select(
        "doc_id",
        "figures.n_words",
        "figures.word_chars",
        "figures.n_symbols",
        "figures.n_dup_lines",
        "figures.n_repeat_words",
        "base_failed",
        "kept",
        "figures.lines_removed",
        "figures.words_left",
    )


def clean(docs: DataFrame) -> DataFrame:
    """The kept rows of `docs` with failed lines taken out of their texts."""
    row = docs.select(F.struct("*").alias("__row"), F.col("text").alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda l: ~l.rlike(WORD) | ~line_fails(l))
    return (
        measures(row)
        .where("kept")
        .select(F.col("__row").withField("text", F.array_join(lines, "\n")).alias("__row"))
        .select("__row.*")
    )
