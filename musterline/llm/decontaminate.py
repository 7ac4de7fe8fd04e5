"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

Every window of an item is a set of word pairs (of single words where an item has one word).
A text that holds the window holds all its pairs, so the necessary prefix is one pair:
the rarest of the window by document frequency. Texts are searched for those pairs only; a
match is placed by the pair's position in the window, bounded by the text's length, and then
verified word for word.

Two passes over the texts: one counts in how many documents the benchmark's pairs occur, one
collects the matches of rare pairs with the words around them. Both test words against a
bitmap with about `BITS_EACH` bits a pair, so that one word in some thirty passes by chance; its size
is bounded (32 MB, enough for 8 million pairs). Pairs that pass by chance are dropped by the
exact join.

Defined cases: null and blank texts have no words; an item without words has no window; an item
shorter than a window is one window of its length; a null item_id can be hit but is not listed;
repeated rows of a document are judged alike, repeated items count once; empty tables on
either side give no hits; extra columns pass through `clean` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from musterline.llm.common import add_words, kept, lower_ascii, whole_rows

# Fixed value: what is not a word character once A-Z are lower-cased.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
# Bitmaps have at least 2**14 longs (128 KB) and at most 2**22 (32 MB), a power of two.
LEAST_CELLS, MOST_CELLS = 14, 22
BITS_EACH = 32


def with_words(frame: DataFrame) -> DataFrame:
    """Adds `w`, the words of the column `text`."""
    return add_words(frame, lower_ascii(F.col("text")), "w", NOT_WORD)


def with_tokens(frame: DataFrame, words: str, size: int) -> DataFrame:
    """Adds `tokens`, a hash of every run of `size` (1 or 2) words, in order."""
    single = frame.withColumn("__single", F.transform(words, lambda w: F.xxhash64(w)))
    if size == 1:
        return single.withColumnRenamed("__single", "tokens")
    rest = F.greatest(F.size("__single") - 1, F.lit(0))
    pairs = F.zip_with(
        F.slice("__single", 1, rest),
        F.slice("__single", 2, rest),
        lambda a, b: F.shiftleft(a, 1).bitwiseXOR(F.shiftrightunsigned(a, 63)).bitwiseXOR(b),
    )
    return single.withColumn("tokens", pairs).drop("__single")


def cells_for(hashes: DataFrame) -> int:
    """Binary logarithm of the longs that a bitmap of these hashes gets."""
    longs = max(1, hashes.count() * BITS_EACH // 64)
    return min(MOST_CELLS, max(LEAST_CELLS, (longs - 1).bit_length()))


def bitmap(hashes: DataFrame, size: int) -> Column:
    """All values of the column `hash` as one array of 2**size longs, a scalar subquery."""
    spark = hashes.sparkSession
    bits = hashes.groupBy(
        F.col("hash").bitwiseAND(F.lit((1 << size) - 1)).alias("cell")
    ).agg(
        F.bit_or(
            F.call_function("shiftleft", F.lit(1).cast("long"), _bit(F.col("hash")))
        ).alias("bits")
    )
    cells = spark.range(1 << size).withColumnRenamed("id", "cell")
    rows = cells.join(bits, "cell", "left").select(
        F.struct("cell", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("row")
    )
    return rows.agg(
        F.transform(F.array_sort(F.collect_list("row")), lambda r: r["bits"]).alias("bitmap")
    ).scalar()


def _bit(value: Column) -> Column:
    return F.shiftrightunsigned(value, 58).cast("int")


def in_bitmap(cells: Column, value: Column, size: int) -> Column:
    cell = F.get(cells, value.bitwiseAND(F.lit((1 << size) - 1)).cast("int"))
    moved = F.call_function("shiftrightunsigned", cell, _bit(value))
    return moved.bitwiseAND(F.lit(1).cast("long")) == 1


def windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(window, item_id) rows: each distinct run of `window` item words, or the whole item."""
    own = with_words(items.select("item_id", "text")).where("size(w) > 0")
    length = F.least(F.size("w"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("w") - length + 1)
    return (
        own.select("item_id", "w", length.alias("length"), F.explode(starts).alias("start"))
        .select(F.slice("w", F.col("start"), F.col("length")).alias("window"), "item_id")
        .distinct()
    )


def rare_tokens(docs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """The prefix of each window in `texts`: its rarest token, with place and length."""
    tokens = with_tokens(texts.select("window"), "window", size).select(
        "window", F.posexplode("tokens").alias("place", "hash")
    )
    distinct = kept(tokens.select("hash").distinct())
    longs = cells_for(distinct)
    cells = bitmap(distinct, longs)
    # The filter is a column of its own: an explode repeats what it is given.
    seen = (
        with_tokens(with_words(docs.select("text")), "w", size)
        .select("tokens", cells.alias("cells"))
        .select(F.filter("tokens", lambda h: in_bitmap(F.col("cells"), h, longs)).alias("own"))
        .select(F.explode(F.array_distinct("own")).alias("hash"))
        .groupBy("hash")
        .agg(F.count("*").alias("documents"))
    )
    ranked = tokens.join(seen, "hash", "left").withColumn(
        "rank", F.struct(F.coalesce("documents", F.lit(0)).alias("n"), "hash", "place")
    )
    return ranked.groupBy("window").agg(F.min("rank").alias("rank")).select(
        "window",
        F.col("rank.place").alias("place"),
        F.col("rank.hash").alias("hash"),
        F.size("window").alias("length"),
    )


def matches(docs: DataFrame, prefixes: DataFrame, size: int, window: int) -> DataFrame:
    """doc_id, text_hash, n_words and the places of rare tokens with the words around them."""
    distinct = prefixes.select("hash").distinct()
    longs = cells_for(distinct)
    cells = bitmap(distinct, longs)
    cut = with_tokens(
        with_words(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))), "w", size
    ).withColumn("cells", cells)
    numbered = F.transform(
        "tokens", lambda h, i: F.when(in_bitmap(F.col("cells"), h, longs), F.struct(h.alias("hash"), i.alias("at")))
    )
    found = F.filter(numbered, lambda t: t.isNotNull())
    reach = window - size
    around = F.transform(
        found,
        lambda t: F.struct(
            t["hash"].alias("hash"),
            t["at"].alias("at"),
            F.greatest(t["at"] - reach, F.lit(0)).alias("from"),
            F.slice(
                F.col("w"),
                F.greatest(t["at"] - reach, F.lit(0)) + 1,
                F.lit(2 * reach + size),
            ).alias("words"),
        ),
    )
    return kept(
        cut.select("doc_id", "text_hash", F.size("w").cast("long").alias("n_words"), around.alias("m"))
    )


def occurrences(found: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(doc_id, text_hash, start, length, window): windows that occur, each verified."""
    places = prefixes.select("hash", "place", "length").distinct()
    rows = found.select("doc_id", "text_hash", "n_words", F.explode("m").alias("m")).select(
        "doc_id", "text_hash", "n_words", "m.*"
    )
    start = F.col("at") - F.col("place")
    return (
        rows.join(places, "hash")
        .withColumn("start", start)
        # Positional and length bounds: the window must lie inside the text.
        .where((F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.col("n_words")))
        .select(
            "doc_id",
            "text_hash",
            "start",
            "length",
            F.slice(
                "words",
                F.greatest(F.col("start") - F.col("from") + 1, F.lit(1)),
                F.col("length"),
            ).alias("window"),
        )
    )


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, items (sorted strings) per row of `docs`."""
    rows = docs.select("doc_id", "text")
    own = kept(windows(items, window))
    texts = own.select("window").distinct()
    hits, base = None, None
    for size in (2, 1):
        part = texts.where(F.size("window") >= 2 if size == 2 else F.size("window") == 1)
        if base is not None and part.isEmpty():
            continue
        prefixes = kept(rare_tokens(rows, part, size))
        found = matches(rows, prefixes, size, window)
        verified = occurrences(found, prefixes).join(own, "window")
        hits = verified if hits is None else hits.unionByName(verified)
        base = found if base is None else base
    by_document = hits.groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_set(F.struct("start", "length"))).alias("spans"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    )
    # Spans in order of their start: what each adds beyond the farthest end so far.
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["start"] + s["length"]).alias("end"),
            (
                acc["n"]
                + F.greatest(s["start"] + s["length"] - F.greatest(acc["end"], s["start"]), F.lit(0))
            ).alias("n"),
        ),
        lambda acc: acc["n"],
    )
    judged = by_document.select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), covered.alias("n_hit"), "items"
    )
    base = base.select("doc_id", "text_hash", "n_words")
    same = base["doc_id"].eqNullSafe(judged["__id"]) & (base["text_hash"] == judged["__hash"])
    return base.join(judged, same, "left").select(
        "doc_id",
        "text_hash",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of `docs` without any hit, with their own columns."""
    bad = (
        contamination(docs, items, window)
        .where("n_hit > 0")
        .select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash"))
        .distinct()
    )
    rows = whole_rows(docs, id="doc_id", text_hash=F.xxhash64("text"))
    same = rows["id"].eqNullSafe(bad["bad_id"]) & (rows["text_hash"] == bad["bad_hash"])
    return rows.join(bad, same, "left_anti").select("row.*")
