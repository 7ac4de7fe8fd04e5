"""Exit answers from questions to leavers with sentiment and themes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from musterline.operators import answers as an
from musterline.operators import leavers as lv
from musterline.operators import sentiment as st
from musterline.operators import terms as tm
from musterline.operators import topics as tp
from musterline.session import durable

# The two corpora, and how their themes are introduced.
PRAISE, CONCERN = "praise", "concern"
ASSIGNED = "array<struct<corpus:string,topic:int,theme:string>>"
THEME_TYPES = {PRAISE: "Praise / Satisfaction", CONCERN: "Concern / Attrition Driver"}


@dataclass(frozen=True)
class ExitInsights:
    """Themes per corpus and one row per leaver.

    A leaver has `answers`, a map by question, `assigned_themes`, the names, and `assigned`,
    structs of corpus, topic and name: two topics may come to the same name.
    """

    themes: DataFrame
    leavers: DataFrame

    def wide(self, questions: Sequence[tuple[str, str]]) -> DataFrame:
        """The leavers with a column per question, as `leavers.questions_of` names them."""
        named = {name: F.col("answers")[question] for question, name in questions}
        return self.leavers.withColumns(named).drop("answers") if named else self.leavers

    def of_theme(self, corpus: str, topic: int) -> DataFrame:
        """The leavers of one theme, for their comments, proof and designations."""
        return lv.leavers_of_topic(self.leavers, corpus, topic)


def scored_leavers(
    answers: DataFrame,
    lexicon: DataFrame,
    order: Column | str | None = None,
    lemmas: DataFrame | None = None,
) -> DataFrame:
    """One row per leaver with key, `answers`, feedback text, tokens and sentiment."""
    spoken = lv.add_leaver_key(spoken_leavers(answers, order))
    return add_scores(spoken, lexicon, lemmas)


def spoken_leavers(answers: DataFrame, order: Column | str | None = None) -> DataFrame:
    """One row per leaver with `answers` and feedback text."""
    return an.add_feedback(an.gather_answers(answers, order), an.questions(answers))


def add_scores(spoken: DataFrame, lexicon: DataFrame, lemmas: DataFrame | None = None) -> DataFrame:
    """Add tokens and sentiment to leavers that have a key."""
    scored = st.add_tokens(st.add_sentiment(spoken, lv.LEAVER_KEY, lexicon))
    if lemmas is None:
        return scored
    based = st.lemmatise(scored, lv.LEAVER_KEY, lemmas)
    return scored.drop("tokens").join(based, lv.LEAVER_KEY)


def corpora_of(leavers: DataFrame, key: str = lv.LEAVER_KEY) -> DataFrame:
    """Tokens of the praising and the concerned leavers; neutral ones are in neither."""
    corpus = F.when(F.col("sentiment") == "Positive", F.lit(PRAISE)).when(
        F.col("sentiment") == "Negative", F.lit(CONCERN)
    )
    return (
        leavers.select(corpus.alias("corpus"), key, "tokens")
        .where(F.col("corpus").isNotNull())
    )


def analyse_exits(
    answers: DataFrame,
    lexicon: DataFrame,
    order: Column | str | None = None,
    lemmas: DataFrame | None = None,
    theme_names: DataFrame | None = None,
) -> ExitInsights:
    """Pivot, score, model both corpora, assign themes.

    `theme_names(corpus, topic, name)` replaces the names made from keywords.
    """
    # The checkpoint fixes the rows, so a number can stand for the long key from here on: the words that
    # meet the lexicon take it along.
    spoken = durable(spoken_leavers(answers, order)).withColumn(
        lv.LEAVER_KEY, F.monotonically_increasing_id()
    )
    scored = durable(add_scores(spoken, lexicon, lemmas))
    docs = corpora_of(scored)
    vocabulary, weighted = tm.numbered_weights(docs, lv.LEAVER_KEY, (PRAISE, CONCERN), unique=True)
    fit = _corpora_large_enough(docs, vocabulary)
    output = scored.drop("full_feedback", "tokens", "compound")
    none = F.array().cast("array<string>")
    if not fit:
        themes = _no_themes(scored)
        return ExitInsights(
            themes,
            output.drop(lv.LEAVER_KEY).withColumns(
                {"assigned_themes": none, "assigned": F.array().cast(ASSIGNED)}
            ),
        )
    # The model divides the weights by their length: it has the documents whole, once it places them.
    weights = weighted.select("corpus", lv.LEAVER_KEY, "term_id", F.col("raw").alias("weight"))
    terms, mixtures = tp.fit_topics(
        weights, lv.LEAVER_KEY, fit, vocabulary=vocabulary, unit_length=True
    )
    themes = durable(name_themes(tp.topic_keywords(terms), theme_names))
    assigned = assign_themes(docs.where(F.col("corpus").isin(*fit)), mixtures, themes)
    tagged = (
        output.join(assigned, lv.LEAVER_KEY, "left")
        .withColumns(
            {
                "assigned_themes": F.coalesce("assigned_themes", none),
                "assigned": F.coalesce("assigned", F.array().cast(ASSIGNED)),
            }
        )
        .drop(lv.LEAVER_KEY)
    )
    return ExitInsights(themes, tagged)


def _corpora_large_enough(docs: DataFrame, vocabulary: DataFrame) -> list[str]:
    """Corpora with at least as many documents and terms as topics: two counts each."""
    documents = docs.groupBy("corpus").agg(F.count(F.lit(1)).alias("n"))
    terms = vocabulary.groupBy("corpus").agg(F.count(F.lit(1)).alias("n"))
    enough = documents.unionByName(terms).groupBy("corpus").agg(
        F.count_if(F.col("n") >= tp.TOPICS).alias("passed")
    )
    return sorted(row["corpus"] for row in enough.where("passed = 2").collect())


def _no_themes(frame: DataFrame) -> DataFrame:
    return frame.sparkSession.createDataFrame(
        [], "corpus string, topic int, theme_type string, theme_name string, keywords array<string>"
    )


def name_themes(keywords: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Name every topic from its first keywords, or by a given table."""
    types = F.when(F.col("corpus") == PRAISE, F.lit(THEME_TYPES[PRAISE])).otherwise(
        F.lit(THEME_TYPES[CONCERN])
    )
    made = F.concat(types, F.lit(": "), F.array_join(F.slice("keywords", 1, 3), " / "))
    table = keywords
    if names is not None:
        table = table.join(names.select("corpus", "topic", "name"), ["corpus", "topic"], "left")
        made = F.coalesce("name", made)
    return table.select(
        "corpus", "topic", types.alias("theme_type"), made.alias("theme_name"), "keywords"
    )


def assign_themes(docs: DataFrame, mixtures: DataFrame, themes: DataFrame) -> DataFrame:
    """All themes of a leaver's corpus above the probability threshold.

    A leaver whose text keeps no term is as likely in every topic. The names are one
    array per corpus, of as many entries as there are topics.
    """
    names = themes.groupBy("corpus").agg(
        F.array_sort(F.collect_list(F.struct("topic", "theme_name"))).alias("names")
    )
    even = F.array_repeat(F.lit(1.0 / tp.TOPICS), tp.TOPICS)
    named = (
        docs.select("corpus", lv.LEAVER_KEY)
        .join(mixtures, ["corpus", lv.LEAVER_KEY], "left")
        .withColumn("mixture", F.coalesce("mixture", even))
        .join(F.broadcast(names), "corpus")
    )
    likely = F.filter("names", lambda n: F.get("mixture", n["topic"]) > tp.ASSIGN_ABOVE)
    return named.select(
        lv.LEAVER_KEY,
        F.transform(likely, lambda n: n["theme_name"]).alias("assigned_themes"),
        F.transform(
            likely, lambda n: F.struct(F.col("corpus").alias("corpus"), n["topic"], n["theme_name"])
        )
        .cast(ASSIGNED)
        .alias("assigned"),
    )
