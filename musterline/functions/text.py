"""Tokens, stop words and n-grams as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WORD = r"[\p{L}\p{N}_]+"

# Words left out of topics. Words with an apostrophe are left out
# of this list, as tokens never hold one.
STOP_WORDS = tuple(
    """
    a about above after again against all am an and any are as at
    be because been before being below between both but by can cannot
    could did do does doing don down during each
    few for from further had has have having he
    her here hers herself him himself his how i
    if in into is it its itself let me
    more most my myself no nor not of off on once only or other
    ought our ours ourselves out over own same shan she
    should so some such than that the their theirs them
    themselves then there these they this
    those through to too under until up very was we
    were what when where which while who
    whom why with won would you
    your yours yourself yourselves
    na yes good fair excellent agree better best company organization work working
    employee partner team sometimes nothing issue backed left join fill
    """.split()
)


def words(text: Column | str) -> Column:
    """All words of a text, lower case, in order."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def content_words(text: Column | str, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Words longer than two letters that are no stop words."""
    return F.filter(words(text), lambda w: (F.length(w) > 2) & ~w.isin(*stop_words))


def model_words(tokens: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Tokens fit for a topic model: base forms can be stop words or one letter long."""
    return F.filter(tokens, lambda w: (F.length(w) > 1) & ~w.isin(*stop_words))


def one_and_two_grams(tokens: Column) -> Column:
    """Every token, then every pair of neighbours joined by a space."""
    pairs = F.zip_with(
        F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))),
        F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return F.concat(tokens, pairs)
