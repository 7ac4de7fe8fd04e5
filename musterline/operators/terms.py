"""TF-IDF as a table: one row per document and term.

A table has no vocabulary on the driver and no size limit. Documents belong to a
`corpus`; every count is taken within it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from musterline.functions.text import STOP_WORDS, model_words, one_and_two_grams
from musterline.operators import term_blocks as tb
from musterline.operators.skew import add_split, copy_per_split, hot_keys
from musterline.session import durable

TERM_KEYS = ("corpus", "term")
# A term with more rows than this may be split over several tasks.
SPLIT_ROWS = 100_000
# Keys of documents are dealt over so many places to find those that come again.
KEY_PLACES = 1 << 16


def term_counts(
    docs: DataFrame, key: str, stop_words: tuple[str, ...] = STOP_WORDS, unique: bool = False
) -> DataFrame:
    """Count of each one- and two-word term per document.

    The tokens are placed by document before they are opened into terms: that moves
    them once, where the terms would be several times as much. A document's terms are
    counted within its row, so no task holds the terms of many documents at once. Only
    documents whose key comes again are added up afterwards, where they already lie; with
    `unique` the caller knows that there are none.
    """
    keys = ("corpus", key)
    kept = docs.select(*keys, model_words(F.col("tokens"), stop_words).alias("kept"))
    # Half of the tasks that adaptive execution would leave read the repeated keys only.
    number = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = kept.where(F.size("kept") > 0).repartition(number, key)
    if unique:
        return _opened(placed, keys)
    marked = placed.withColumn("rows", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    single = _opened(marked.where("rows = 1"), keys)
    again = _opened(marked.where("rows > 1"), keys)
    return single.unionByName(again.groupBy(*keys, "term").agg(F.sum("tf").alias("tf")))


def _opened(kept: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The terms of each row with their counts: the lengths of the runs once they are sorted."""
    term = lambda place: F.get("terms", place)
    starts = F.filter(
        F.sequence(F.lit(0), F.size("terms") - 1),
        lambda i: (i == 0) | (term(i) != term(i - 1)),
    )
    runs = F.transform(
        "starts",
        lambda start, number: F.struct(
            term(start).alias("term"),
            (F.coalesce(F.get("starts", number + 1), F.size("terms")) - start)
            .cast("long")
            .alias("tf"),
        ),
    )
    return (
        kept.select(*keys, F.sort_array(one_and_two_grams(F.col("kept"))).alias("terms"))
        .withColumn("starts", starts)
        .select(*keys, F.inline(runs))
    )


def corpus_size(docs: DataFrame, corpora: tuple[str, ...]) -> Column:
    """Documents in the row's corpus, as one subquery per named corpus."""
    size = F.lit(None).cast("long")
    for name in corpora:
        count = docs.where(F.col("corpus") == name).agg(F.count(F.lit(1)).alias("n")).scalar()
        size = F.when(F.col("corpus") == name, count).otherwise(size)
    return size


def kept_terms(
    counts: DataFrame,
    docs: DataFrame,
    corpora: tuple[str, ...],
    min_docs: int = 2,
    max_share: float = 0.9,
) -> DataFrame:
    """Terms in at least `min_docs` and at most `max_share` of the documents, with idf."""
    frequencies = (
        counts.groupBy(*TERM_KEYS)
        .agg(F.count(F.lit(1)).alias("df"))
        .withColumn("docs", corpus_size(docs, corpora))
    )
    idf = F.log((F.col("docs") + 1) / (F.col("df") + 1)) + 1
    return (
        frequencies.where((F.col("df") >= min_docs) & (F.col("df") <= F.col("docs") * max_share))
        .withColumn("idf", idf)
        .drop("docs")
    )


def tfidf(
    docs: DataFrame,
    key: str,
    corpora: tuple[str, ...],
    stop_words: tuple[str, ...] = STOP_WORDS,
    min_docs: int = 2,
    max_share: float = 0.9,
) -> DataFrame:
    """L2-normalised weights: corpus, key, term, tf, df, idf, weight.

    The documents stay where they are read, in blocks that are written to the shared folder once.
    Only those whose key comes again, or shares a place with such a key, are brought together and
    counted as rows first.
    """
    sized = lambda frame: frame.withColumn("docs", corpus_size(docs, corpora))
    rows = _rows_of_documents(docs.where(F.col("corpus").isin(*corpora)), key, stop_words)
    blocks = durable(tb.cut_into_blocks(rows))
    tokens, parts, tasks = blocks.agg(
        F.sum("tokens"), F.count_if(~F.col("whole")), F.count_distinct(tb.task_of("block"))
    ).first()
    shelves = tb.shelves_for(blocks, tokens or 0)
    answers = tb.kept_by_blocks(blocks, sized, shelves, tasks, min_docs, max_share)
    answered = sized(blocks.join(answers, "block"))
    weighted = tb.weigh(answered.where("whole"), docs.schema[key], shelves)
    if parts:
        norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("corpus", key)))
        again = tb.weigh(answered.where("not whole"), docs.schema[key], shelves)
        weighted = weighted.unionByName(again.withColumn("weight", F.col("weight") / norm))
    idf = F.log((F.col("docs") + 1) / (F.col("df") + 1)) + 1
    return sized(weighted).select("corpus", key, "term", "tf", "df", idf.alias("idf"), "weight")


def _rows_of_documents(docs: DataFrame, key: str, stop_words: tuple[str, ...]) -> DataFrame:
    """A `whole` row per document, or for documents of several rows a row per term with its count.

    The repeated keys are known by a bounded list of places, so the documents need not move to
    find them.
    """
    keys = ("corpus", key)
    place = F.pmod(F.xxhash64(*keys), F.lit(KEY_PLACES))
    repeated = docs.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    repeated = durable(repeated.select(place.alias("key_place")).distinct())
    kept = docs.select(*keys, model_words(F.col("tokens"), stop_words).alias("tokens"))
    once = F.lit(1).cast("long").alias("times")
    if repeated.isEmpty():
        return kept.select(*keys, "tokens", once, F.lit(True).alias("whole"))
    places = F.broadcast(repeated)
    single = kept.withColumn("key_place", place).join(places, "key_place", "left_anti")
    several = docs.select(*keys, "tokens", place.alias("key_place")).join(places, "key_place", "left_semi")
    counted = term_counts(several.drop("key_place"), key, stop_words)
    terms = counted.select(*keys, F.array("term").alias("tokens"), F.col("tf").alias("times"))
    whole = single.select(*keys, "tokens", once, F.lit(True).alias("whole"))
    return whole.unionByName(terms.withColumn("whole", F.lit(False)))


def tfidf_by_split(
    docs: DataFrame,
    key: str,
    corpora: tuple[str, ...],
    stop_words: tuple[str, ...] = STOP_WORDS,
    min_docs: int = 2,
    max_share: float = 0.9,
) -> DataFrame:
    """`tfidf` with a number of each term and the splits of frequent terms, for later joins on the term.

    `docs` has `corpus`, a unique `key` and `tokens`. A term can be in most
    documents, so frequent terms are split before the join on the term. The terms serve the
    list of frequent ones and the join, and are written to the shared folder once, so their
    numbers stay. The counts are many times as large as the tokens and are formed again where
    they are read.
    """
    weighted = numbered_weights(docs, key, corpora, stop_words, min_docs, max_share)[1]
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("corpus", key)))
    return weighted.select(
        "corpus",
        key,
        "term",
        "tf",
        "df",
        "idf",
        (F.col("raw") / norm).alias("weight"),
        "term_id",
        "split",
        "splits",
    )


def numbered_weights(
    docs: DataFrame,
    key: str,
    corpora: tuple[str, ...],
    stop_words: tuple[str, ...] = STOP_WORDS,
    min_docs: int = 2,
    max_share: float = 0.9,
    unique: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """The kept terms with their numbers (corpus, term, df, idf, term_id), and those of each document
    with tf, split, splits and `raw`, the weight before a document's are brought to unit length."""
    counts = term_counts(docs, key, stop_words, unique)
    terms = durable(kept_terms(counts, docs, corpora, min_docs, max_share))
    hot = hot_keys(terms, TERM_KEYS, "df", least=SPLIT_ROWS)
    numbered = terms.withColumn("term_id", F.monotonically_increasing_id())
    # The terms of a task fit its memory many times over; so the counts need not be sorted.
    joined = add_split(counts, hot, TERM_KEYS, spread=key).join(
        copy_per_split(numbered, hot, TERM_KEYS).hint("shuffle_hash"), [*TERM_KEYS, "split"]
    )
    return numbered, joined.withColumn("raw", F.col("tf") * F.col("idf"))
