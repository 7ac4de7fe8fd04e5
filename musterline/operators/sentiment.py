"""Tokens, base forms and lexicon sentiment of feedback texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from musterline.functions.text import STOP_WORDS, content_words, words

# The normalising constant of the compound score and its thresholds.
COMPOUND_ALPHA = 15
POSITIVE_FROM = 0.05
NEGATIVE_UP_TO = -0.05
# Maps over which the changed tokens of one document are spread.
FORM_MAPS = 16


def add_tokens(
    docs: DataFrame, text: str = "full_feedback", stop_words: tuple[str, ...] = STOP_WORDS
) -> DataFrame:
    return docs.withColumn("tokens", content_words(text, stop_words))


def lemmatise(docs: DataFrame, key: str, lemmas: DataFrame) -> DataFrame:
    """Replace each token by its base form from `lemmas(token, lemma)`.

    Returns `key` and `tokens` in the old order. Tokens without an entry stay; of several
    entries for one token the first by code point counts.
    Only the distinct tokens of a document meet the table, and only those with another base form
    come back, as small maps; the tokens themselves stay where they are, in order. The join
    takes no hint: Spark broadcasts the table only while its size allows, and splits frequent
    tokens otherwise.
    """
    single = lemmas.groupBy("token").agg(F.min("lemma").alias("lemma")).where("lemma <> token")
    distinct = docs.select(key, F.explode(F.array_distinct("tokens")).alias("token"))
    # Entries of a document in a few maps by hash, as a map is searched from its start.
    forms = F.transform(
        F.sequence(F.lit(0), F.lit(FORM_MAPS - 1)),
        lambda n: F.map_from_entries(
            F.filter("entries", lambda e: F.pmod(F.hash(e["token"]), F.lit(FORM_MAPS)) == n)
        ),
    )
    changed = (
        distinct.join(single, "token")
        .groupBy(key)
        .agg(F.collect_list(F.struct("token", "lemma")).alias("entries"))
        .select(key, forms.alias("forms"))
    )
    based = F.transform(
        "tokens",
        lambda t: F.coalesce(F.get("forms", F.pmod(F.hash(t), F.lit(FORM_MAPS)))[t], t),
    )
    tokens = F.when(F.col("forms").isNull(), F.col("tokens")).otherwise(based)
    return (
        docs.select(key, "tokens")
        .join(changed, key, "left")
        .select(key, F.coalesce(tokens, F.array().cast("array<string>")).alias("tokens"))
    )


def cleaned_text(tokens="tokens"):
    return F.array_join(tokens, " ")


def sentiment_scores(docs: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """Sum of valences per document, for documents with any token in the lexicon.

    Tokens of one document lie together, so the sums are formed before the shuffle
    and only one number per document travels. Of several entries for one token the
    lowest valence counts.
    """
    single = lexicon.groupBy("token").agg(F.min("valence").alias("valence"))
    return (
        docs.select(key, F.explode(words(text)).alias("token"))
        .join(single, "token")
        .groupBy(key)
        .agg(F.sum("valence").alias("valence"))
    )


def add_sentiment(
    docs: DataFrame, key: str, lexicon: DataFrame, text: str = "full_feedback"
) -> DataFrame:
    """Add `compound` in [-1, 1] and its label; no known token means Neutral."""
    scores = sentiment_scores(docs, key, text, lexicon)
    total = F.coalesce("valence", F.lit(0.0))
    compound = total / F.sqrt(total * total + COMPOUND_ALPHA)
    label = (
        F.when(F.col("compound") >= POSITIVE_FROM, F.lit("Positive"))
        .when(F.col("compound") <= NEGATIVE_UP_TO, F.lit("Negative"))
        .otherwise(F.lit("Neutral"))
    )
    return (
        docs.join(scores, key, "left")
        .withColumn("compound", compound)
        .withColumn("sentiment", label)
        .drop("valence")
    )


def praise(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("sentiment") == "Positive")


def concern(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("sentiment") == "Negative")
