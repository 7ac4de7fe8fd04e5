"""Mixing sources to target weights.

Every document gets a hash-random key. Documents are range-sorted by it within their source,
a distributed prefix sum of word counts runs along that order, and each source is cut at
its exact budget. A budget over the source's size takes whole epochs first.

The keys are uniform, so equal ranges of the key are equal shares of a source: a source of n
documents has about sqrt(n) ranges of sqrt(n) documents. Sums run inside a range, then over
the ranges; no task sees a source whole. Equal rows (id, source, text) are counted first and
travel as one row with a count.

Defined cases: a null source is a source, the last; null and blank texts have size 0 and nothing
is taken of them; if all sizes are 0 all targets are 0; of equal rows the first copies are taken
whole, one is cut where the budget ends and none is taken after it; an empty table gives an empty
result; extra columns, whatever their names, pass through `mixed`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from musterline.llm.common import WORD, each_copy, kept, whole_rows

WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3
SEED = "mix-1"
# Cuts up to this size are broadcast; one takes its source's name and about CUT_BYTES.
BROADCAST_BYTES = 4 << 20
CUT_BYTES = 200


def size_of(text: Column) -> Column:
    """Number of words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _same(left: DataFrame, right: DataFrame, pairs: dict[str, str]) -> Column:
    out = F.lit(True)
    for a, b in pairs.items():
        out = out & left[a].eqNullSafe(right[b])
    return out


def ranked(sources: DataFrame) -> DataFrame:
    """Adds `rank`, the position of a source by code point, null last, from 0.

    Ranges of sources are counted, then rows inside a range; the ranges are written down
    first, as their bounds are sampled.
    """
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = kept(
        sources.repartitionByRange(parts, F.col("source").asc_nulls_last()).withColumn(
            "part", F.spark_partition_id()
        )
    )
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = dealt.groupBy("part").agg(F.count("*").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    inside = W.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return (
        dealt.withColumn("place", F.row_number().over(inside) - 1)
        .join(offsets, "part")
        .withColumn("rank", F.col("offset") + F.col("place"))
        .drop("part", "place", "offset")
    )


def targets(sources: DataFrame, weights: Sequence[int], most_epochs: int) -> DataFrame:
    """Adds `target`: shares by weight, stopped at `most_epochs` sizes, the excess reshared.

    `sources` has source and source_size. Each pass finds which sources are above their
    stop at the present level; only two sums come to the driver.
    """
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    placed = kept(
        ranked(sources)
        .withColumn("weight", F.get(cycle, (F.col("rank") % len(weights)).cast("int")).cast("long"))
        .withColumn("stop", F.col("source_size") * most_epochs)
    )
    first = placed.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    whole, rest, share = first["size"] or 0, first["size"] or 0, first["weight"] or 1
    above = F.lit(False)
    while whole:
        exact = "decimal(38,0)"
        above = F.col("stop").cast(exact) * F.lit(share) < F.col("weight").cast(exact) * F.lit(rest)
        stopped = placed.where(above).agg(
            F.sum("stop").alias("stop"), F.sum("weight").alias("weight")
        ).first()
        left = whole - (stopped["stop"] or 0)
        open_share = first["weight"] - (stopped["weight"] or 0)
        if (left, open_share) == (rest, share):
            break
        rest, share = left, open_share
    level = F.lit(float(rest)) * F.col("weight").cast("double") / F.lit(float(share))
    return placed.withColumn("target", F.when(above, F.col("stop").cast("double")).otherwise(level))


def row_key(doc_id: Column, text_key: Column, seed: str) -> Column:
    """The hash-random key of a row, the same wherever it is computed."""
    return F.md5(F.concat_ws("/", F.lit(seed), doc_id.cast("string"), text_key))


def ordered(
    docs: DataFrame, weights: Sequence[int], most_epochs: int, seed: str
) -> tuple[DataFrame, DataFrame]:
    """The sources with `epochs` and `budget`, and the distinct rows with their `start`.

    `budget` is what is left of a source's target after whole epochs, `start` the words of the
    source before a row in the order of the keys.
    """
    rows = kept(
        docs.select("doc_id", "source", F.md5("text").alias("text_key"), size_of(F.col("text")).alias("size"))
        .groupBy("doc_id", "source", "text_key", "size")
        .agg(F.count("*").alias("copies"))
        .withColumn("key", row_key(F.col("doc_id"), F.col("text_key"), seed))
    )
    total = F.col("size") * F.col("copies")
    sizes = rows.groupBy("source").agg(
        F.sum(total).alias("source_size"), F.count("*").alias("documents")
    )
    whole = F.when(
        F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))
    ).otherwise(0)
    sources = (
        targets(sizes, weights, most_epochs)
        .withColumn("epochs", whole.cast("long"))
        .select(
            F.col("source").alias("__source"),
            "source_size",
            "target",
            "epochs",
            (F.floor("target") - F.col("epochs") * F.col("source_size")).alias("budget"),
            F.ceil(F.sqrt("documents")).cast("long").alias("ranges"),
        )
    )
    # The first 32 bits of the key, scaled to the number of ranges of the source.
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    ranged = rows.join(sources, _same(rows, sources, {"source": "__source"})).withColumn(
        "range", F.shiftright(place * F.col("ranges"), 32)
    )
    inside = W.partitionBy("source", "range").orderBy("key", "doc_id", "size")
    running = ranged.withColumn("upto", F.sum(total).over(inside.rowsBetween(W.unboundedPreceding, 0)))
    sums = running.groupBy("source", "range").agg(F.max("upto").alias("sum"))
    before = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("source").alias("__own"),
        F.col("range").alias("__range"),
        F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("offset"),
    )
    joined = running.join(
        offsets, _same(running, offsets, {"source": "__own", "range": "__range"})
    )
    started = joined.withColumn("start", F.col("offset") + F.col("upto") - total)
    return sources, started.withColumn("total", total)


def within_budget() -> Column:
    """Words of one more, partial repeat that all copies of a row of `ordered` give together."""
    return F.least(F.greatest(F.col("budget") - F.col("start"), F.lit(0)), F.col("total")).cast("long")


def part_of(copy: Column, size: Column, within: Column) -> Column:
    """What of `within` is this copy's (from 1): the first copies whole, then one cut."""
    return F.least(F.greatest(within - (copy - 1) * size, F.lit(0)), size)


def plan(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    most_epochs: int = MOST_EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """One row per distinct (doc_id, source, text) with what the mix takes of it.

    doc_id, source, text_key, copies, size, source_size, target, epochs (whole repeats of every
    copy) and within (words of one more, partial repeat, of all copies together).
    """
    _, rows = ordered(docs, weights, most_epochs, seed)
    return rows.select(
        "doc_id",
        "source",
        "text_key",
        "copies",
        "size",
        "source_size",
        "target",
        "epochs",
        within_budget().alias("within"),
    )


def cuts(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    most_epochs: int = MOST_EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """One row per source: its epochs, and the row `__edge` at which its budget ends.

    Rows before the edge give a whole repeat more, the `__edge_copies` copies of the edge give
    `__edge_words` words together, rows behind it nothing. A source without a budget beyond its
    epochs has no edge.
    """
    sources, rows = ordered(docs, weights, most_epochs, seed)
    ends = (F.col("start") < F.col("budget")) & (F.col("budget") <= F.col("start") + F.col("total"))
    edges = rows.where(ends).select(
        F.col("source").alias("__cut"),
        F.struct("key", "doc_id", "size").alias("__edge"),
        within_budget().alias("__edge_words"),
        F.col("copies").alias("__edge_copies"),
    )
    return sources.join(edges, _same(sources, edges, {"__source": "__cut"}), "left").select(
        "__source", F.col("epochs").alias("__epochs"), "__edge", "__edge_words", "__edge_copies"
    )


def taken(planned: DataFrame) -> DataFrame:
    """One row per document with the words taken of it, repeats counted."""
    part = part_of(F.col("copy"), F.col("size"), F.col("within"))
    return each_copy(planned, F.col("copies")).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("epochs") * F.col("size") + part).alias("taken"),
    )


def first_words(text: Column, n: Column) -> Column:
    """The text up to its n-th word, white space kept."""
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    return F.array_join(F.slice(pieces, 1, n.cast("int")), "")


def mixed(docs: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """The mix itself: rows of `docs` once per epoch, the row at the cut shortened to its part.

    Columns are those of `docs`; a column n_chars follows a shortened text. A row learns from its
    own key and the cut of its source what is taken of it, so texts are not shuffled while the
    cuts are small (checked, `BROADCAST_BYTES`); beyond that they are joined by source, where
    adaptive execution splits a hot one.
    """
    cut = kept(cuts(docs, seed=seed, **options))
    held = cut.agg(
        F.sum(F.coalesce(F.octet_length("__source"), F.lit(0)) + CUT_BYTES).alias("bytes"),
        F.max("__edge_copies").alias("copies"),
    ).first()
    rows = whole_rows(
        docs,
        doc_id="doc_id",
        source="source",
        text="text",
        size=size_of(F.col("text")),
        key=row_key(F.col("doc_id"), F.md5("text"), seed),
    )
    near = F.broadcast(cut) if (held["bytes"] or 0) <= BROADCAST_BYTES else cut
    placed = rows.join(near, _same(rows, cut, {"source": "__source"})).withColumn(
        "own", F.struct("key", "doc_id", "size")
    )
    # A single edge is cut where it lies; copies of an edge are numbered apart.
    part = (
        F.when(F.col("own") < F.col("__edge"), F.col("size"))
        .when((F.col("own") == F.col("__edge")) & (F.col("__edge_copies") == 1), F.col("__edge_words"))
        .otherwise(0)
    )
    repeats = F.col("__epochs") + (F.col("part") > 0).cast("long")
    # A sequence from 1 to 0 would count down.
    repeated = placed.withColumn("part", part).where(repeats > 0).withColumn(
        "repeat", F.explode(F.sequence(F.lit(1).cast("long"), repeats))
    )
    words = F.when(F.col("repeat") > F.col("__epochs"), F.col("part")).otherwise(F.col("size"))
    out = repeated.select("row", "text", "size", words.alias("words"))
    if (held["copies"] or 0) > 1:
        out = out.unionByName(_copies_at_edges(placed))
    short = F.col("words") < F.col("size")
    text = F.when(short, first_words(F.col("text"), F.col("words"))).otherwise(F.col("text"))
    changed = F.col("row").withField("text", text)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        changed = changed.withField(
            "n_chars",
            F.when(short, F.length(text).cast(kind)).otherwise(F.col("row.n_chars")),
        )
    return out.select(changed.alias("row")).select("row.*")


def _copies_at_edges(placed: DataFrame) -> DataFrame:
    """The further repeats of edges with several copies: whole ones, then one cut.

    Copies agree in id, source and text; any one of them stands for all. There is one edge per
    source, taken together before the shuffle.
    """
    edges = (
        placed.where((F.col("own") == F.col("__edge")) & (F.col("__edge_copies") > 1))
        .groupBy("source", "own", "__edge_words")
        .agg(F.first("row").alias("row"), F.first("text").alias("text"))
        .withColumn("size", F.col("own.size"))
    )
    copies = F.ceil(F.col("__edge_words") / F.col("size"))
    return each_copy(edges, copies).select(
        "row", "text", "size", part_of(F.col("copy"), F.col("size"), F.col("__edge_words")).alias("words")
    )
