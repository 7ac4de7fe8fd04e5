"""Topic model over a TF-IDF table: batch variational LDA as joins and groupings.

Both the documents and the term-topic table stay distributed, so the vocabulary is
not limited by the driver. One pass is: give each document its terms' topic
weights, fit the document's topic mixture, add up what each term got. The documents lie in
blocks in a bucketed table and the terms on shelves, both numbered once. A pass moves one row of
arrays from every shelf to every block that has terms of it and one back: a term twice per
block, without its number, and never a weight or a text.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce
from math import ceil
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from musterline.functions import special
from musterline.functions.special import digamma
from musterline.operators.terms import TERM_KEYS
from musterline.session import durable

# Topics per corpus, passes over the data, seed, and when the mixture
# of one document counts as settled.
TOPICS = 4
PASSES = 10
SEED = 42
MIXTURE_STEPS = 100
MIXTURE_TOLERANCE = 1e-3
# Keywords per topic and the probability that assigns a topic.
KEYWORDS = 5
ASSIGN_ABOVE = 0.2
# Terms are ranked by their mass to so many places.
RANKED_PLACES = 6
# Groups of terms whose heaviest members bound what can be ranked.
RANKED_GROUPS = 256
# Shape of the random start, a gamma distribution with mean 1.
START_SHAPE = 100.0
TINY = float(np.finfo(float).eps)
# Weights of a block of documents: bounds the memory of its arrays in a Python worker. The more, the
# fewer blocks share a term. Fewer in small tables, so that all tasks get some, down to the second number.
BLOCK_WEIGHTS = 1_000_000
LEAST_BLOCK_WEIGHTS = 250_000
# Terms of documents fitted at once: enough that the calls cost less than the numbers. Such documents are
# of about one size, with so many steps from a size to its double.
CHUNK_TERMS = 128_000
SIZE_STEPS = 2
# Terms of a shelf, and shelves per task in small vocabularies: a pass moves a row of arrays from each
# shelf to each block and back.
SHELF_TERMS = 20_000
LEAST_SHELVES = 4
SHELF = (
    "shelf int, weights array<double>, sums array<double>, blocks array<int>, sizes array<int>,"
    " places array<int>"
)

# Python workers get the fit by value and need no copy of this package.
for _module in (sys.modules[__name__], special):
    cloudpickle.register_pickle_by_value(_module)


def fit_topics(
    weights: DataFrame,
    key: str,
    corpora: Sequence[str],
    topics: int = TOPICS,
    passes: int = PASSES,
    seed: int = SEED,
    vocabulary: DataFrame | None = None,
    unit_length: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Fit one model per corpus on weights (corpus, key, term_id, weight), read once.

    `vocabulary` has their terms (corpus, term, term_id, df), best a durable table; without it,
    `weights` must have `term` too and be durable. With `unit_length` the weights of a
    document are first divided by their length. Returns the term table (corpus, term,
    topic_0 ..) and the mixtures of the documents (corpus, key, mixture: array of probabilities).
    """
    names = [f"topic_{i}" for i in range(topics)]
    table = f"musterline_{uuid.uuid4().hex}"
    if vocabulary is None:
        by_term = weights.groupBy(*TERM_KEYS, "term_id").agg(F.count(F.lit(1)).alias("df"))
        vocabulary = durable(by_term)
    vocabulary = vocabulary.where(F.col("corpus").isin(*corpora))
    size = vocabulary.agg(F.count(F.lit(1)).alias("terms"), F.sum("df").alias("weights")).first()
    tasks = int(weights.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shelves = max(ceil(size.terms / SHELF_TERMS), min(size.terms, LEAST_SHELVES * tasks), 1)
    vocabulary = vocabulary.withColumn("shelf", _numbered(F.col("term_id") % shelves, shelves, corpora))
    blocks = _in_blocks(weights, key, corpora, table, size.weights or 0, shelves, unit_length)
    starts = [_start(i, seed).alias(name) for i, name in enumerate(names)]
    terms = durable(_on_shelves(vocabulary.select("shelf", "term_id", *starts), blocks, names))
    for _ in range(passes):
        factors = _term_factors(terms, len(corpora), topics, shelves)
        terms = durable(_gather_terms(_give_to_terms(blocks, factors, topics), names))
    factors = _term_factors(terms, len(corpora), topics, shelves)
    mixtures = durable(_mixtures(blocks, factors, key, corpora, topics))
    named = durable(_named(vocabulary, terms, names))
    weights.sparkSession.sql(f"DROP TABLE {table}")
    return named, mixtures


def _numbered(place: Column, places: int, corpora: Sequence[str]) -> Column:
    """The places of all corpora in one row of numbers, those of a corpus next to each other."""
    number = F.lit(None).cast("int")
    for i, corpus in enumerate(corpora):
        number = F.when(F.col("corpus") == corpus, i).otherwise(number)
    return (number * places + place).cast("int")


def _in_blocks(
    weights: DataFrame,
    key: str,
    corpora: Sequence[str],
    table: str,
    rows: int,
    shelves: int,
    unit_length: bool,
) -> DataFrame:
    """The documents in blocks, one row each, as a table in the warehouse bucketed by block.

    `terms` are the distinct term ids of the block by shelf, `shelves` the shelves they lie on, `place`
    the place among them of every weight's term, `sizes` the number of weights of each document."""
    number = int(weights.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(ceil(rows / BLOCK_WEIGHTS), min(number, ceil(rows / LEAST_BLOCK_WEIGHTS)), 1)
    dealt = F.pmod(F.xxhash64("corpus", key), F.lit(blocks))
    items = weights.where(F.col("corpus").isin(*corpora)).select(
        _numbered(dealt, blocks, corpora).alias("block"),
        (_numbered(F.lit(0), 1, corpora)).alias("number"),
        F.col(key).alias("key"),
        "term_id",
        "weight",
    )
    kind = weights.schema[key].dataType.simpleString()
    schema = (
        f"block int, number int, keys array<{kind}>, shelves array<int>, terms array<array<long>>,"
        " place array<int>, weight array<double>, sizes array<int>"
    )
    place = lambda block: _block_of(block, shelves, unit_length)
    buckets = max(blocks, number)
    # Dealt as the buckets are, so that a task writes one file.
    placed = items.repartition(buckets, "block").groupBy("block").applyInArrow(place, schema)
    placed.write.bucketBy(buckets, "block").format("parquet").saveAsTable(table)
    return weights.sparkSession.table(table)


def _block_of(items: pa.Table, shelves: int, unit_length: bool) -> pa.Table:
    """One row from the weights of a block, its terms numbered within it."""
    codes = items["key"].combine_chunks().dictionary_encode(null_encoding="encode")
    document = codes.indices.to_numpy(zero_copy_only=False)
    by_document = np.argsort(document, kind="stable")
    sizes = np.bincount(document, minlength=len(codes.dictionary))
    weight = items["weight"].to_numpy()[by_document]
    if unit_length:
        squares = np.add.reduceat(weight * weight, np.cumsum(sizes) - sizes)
        weight = weight / np.repeat(np.sqrt(squares), sizes)
    numbers = items["term_id"].combine_chunks().dictionary_encode()
    ids = numbers.dictionary.to_numpy()
    by_shelf = np.lexsort((ids, ids % shelves))
    order = np.empty(len(ids), dtype=np.int32)
    order[by_shelf] = np.arange(len(ids), dtype=np.int32)
    place = order[numbers.indices.to_numpy()[by_document]]
    held, terms = np.unique(ids % shelves, return_counts=True)
    number = items["number"][0].as_py()
    one = lambda values, kind: pa.ListArray.from_arrays([0, len(values)], pa.array(values, kind))
    by_shelves = _lists(ids[by_shelf], terms)
    return pa.table({
        "block": items["block"].combine_chunks()[:1],
        "number": items["number"].combine_chunks()[:1],
        "keys": pa.ListArray.from_arrays([0, len(sizes)], codes.dictionary),
        "shelves": one(held + number * shelves, pa.int32()),
        "terms": pa.ListArray.from_arrays([0, len(by_shelves)], by_shelves),
        "place": one(place, pa.int32()),
        "weight": one(weight, pa.float64()),
        "sizes": one(sizes, pa.int32()),
    })


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """The values as lists of such sizes."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(values))


def _values(lists: pa.ChunkedArray) -> np.ndarray:
    """The elements of all lists, one after another."""
    return lists.combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _sizes(lists: pa.ChunkedArray) -> np.ndarray:
    return lists.combine_chunks().value_lengths().to_numpy(zero_copy_only=False)


def _start(topic: int, seed: int) -> Column:
    """Gamma(shape 100, mean 1) draw from a hash of the term, the same on every run.

    The first 32 bits of two MD5 digests give a normal deviate, its cube root form the gamma."""
    place = [F.col(name) for name in TERM_KEYS]

    def uniform(salt: int) -> Column:
        digest = F.md5(F.concat_ws("/", *place, *[F.lit(str(x)) for x in (topic, seed, salt)]))
        bits = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
        return (bits + 0.5) / float(1 << 32)

    normal = F.sqrt(F.log(uniform(1)) * -2.0) * F.cos(uniform(2) * (2 * np.pi))
    ninth = 1.0 / (9.0 * START_SHAPE)
    return F.pow(normal * float(np.sqrt(ninth)) + (1.0 - ninth), F.lit(3.0))


def _on_shelves(starts: DataFrame, blocks: DataFrame, names: Sequence[str]) -> DataFrame:
    """The terms of each shelf in one row, ordered by number, with their first topic weights.

    `weights` are those of the terms one after another, `sums` their totals, `blocks` the blocks that
    have terms of the shelf, and `places` which ones each has: as many as `sizes` says."""
    names = list(names)

    def shelve(terms: pa.Table, wanted: pa.Table) -> pa.Table:
        ids, order = terms["term_id"].to_numpy(), np.argsort(terms["term_id"].to_numpy())
        weights = np.column_stack([terms[name].to_numpy()[order] for name in names])
        places = np.searchsorted(ids[order], _values(wanted["terms"])).astype(np.int32)
        return _shelf(terms["shelf"][0], weights, wanted["block"], _sizes(wanted["terms"]), places)

    wanted = blocks.select("block", F.inline(F.arrays_zip("shelves", "terms"))).withColumnRenamed(
        "shelves", "shelf"
    )
    return starts.groupBy("shelf").cogroup(wanted.groupBy("shelf")).applyInArrow(shelve, SHELF)


def _shelf(shelf, weights: np.ndarray, blocks, sizes: np.ndarray, places: np.ndarray) -> pa.Table:
    one = lambda values, kind: pa.array([values], pa.list_(kind))
    return pa.table({
        "shelf": pa.array([shelf.as_py()], pa.int32()),
        "weights": one(weights.ravel(), pa.float64()),
        "sums": one(weights.sum(axis=0), pa.float64()),
        "blocks": one(blocks.to_numpy(), pa.int32()),
        "sizes": one(sizes, pa.int32()),
        "places": one(places, pa.int32()),
    })


def _term_factors(terms: DataFrame, corpora: int, topics: int, shelves: int) -> DataFrame:
    """exp E[log beta] of the terms of a shelf, a row for every block that has some of them.

    The topic totals of the corpora are one row, which enters as a subquery."""
    own = (F.col("shelf") / F.lit(shelves)).cast("int")
    totals = [
        F.coalesce(F.sum(F.when(own == corpus, F.get("sums", F.lit(topic)))), F.lit(0.0))
        for corpus in range(corpora)
        for topic in range(topics)
    ]

    def open_shelves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield factors_of(batch.slice(row, 1))

    def factors_of(shelf: pa.RecordBatch) -> pa.RecordBatch:
        values = {n: shelf[n].flatten().to_numpy() for n in ("weights", "blocks", "sizes", "places", "totals")}
        number = shelf["shelf"][0].as_py()
        whole = values["totals"].reshape(corpora, topics)[number // shelves]
        beta = np.exp(digamma(values["weights"].reshape(-1, topics)) - digamma(whole))
        return pa.RecordBatch.from_pydict({
            "block": values["blocks"],
            "shelf": np.full(len(values["blocks"]), number, dtype=np.int32),
            "places": _lists(values["places"], values["sizes"]),
            "factors": _lists(beta[values["places"]].ravel(), values["sizes"] * topics),
        })

    schema = "block int, shelf int, places array<int>, factors array<double>"
    return (
        terms.withColumn("totals", terms.agg(F.array(*totals).alias("totals")).scalar())
        .mapInArrow(open_shelves, schema)
    )


def _give_to_terms(blocks: DataFrame, factors: DataFrame, topics: int) -> DataFrame:
    """What the documents of each block give to its terms: one row per block and shelf."""
    prior = 1.0 / topics

    def give(block: pa.Table, factors: pa.Table) -> pa.Table:
        weight, place, sizes = (_values(block[n]) for n in ("weight", "place", "sizes"))
        factors = factors.sort_by("shelf")
        beta = _beta(factors, topics)
        terms, beta = beta.shape[1], beta[:, place]
        theta = np.repeat(_theta_of(_settled(weight, beta, sizes, prior)), sizes, axis=1)
        theta *= beta
        theta *= weight / (theta.sum(axis=0) + TINY)
        given = np.column_stack([np.bincount(place, weights=t, minlength=terms) for t in theta])
        return pa.table({
            "shelf": factors["shelf"],
            "block": factors["block"],
            "places": factors["places"],
            "given": _lists(given.ravel(), _sizes(factors["factors"])),
        })

    schema = "shelf int, block int, places array<int>, given array<double>"
    return (
        blocks.select("block", "weight", "place", "sizes")
        .groupBy("block")
        .cogroup(factors.groupBy("block"))
        .applyInArrow(give, schema)
    )


def _mixtures(
    blocks: DataFrame, factors: DataFrame, key: str, corpora: Sequence[str], topics: int
) -> DataFrame:
    """The topic shares of every document: corpus, key, mixture."""
    prior, corpora = 1.0 / topics, list(corpora)

    def mix(block: pa.Table, factors: pa.Table) -> pa.Table:
        weight, place, sizes = (_values(block[n]) for n in ("weight", "place", "sizes"))
        gamma = _settled(weight, _beta(factors.sort_by("shelf"), topics)[:, place], sizes, prior)
        mixture = np.ascontiguousarray((gamma / gamma.sum(axis=0)).T)
        return pa.table({
            "corpus": pa.repeat(corpora[block["number"][0].as_py()], len(sizes)),
            key: block["keys"].combine_chunks().flatten(),
            "mixture": _lists(mixture.ravel(), np.full(len(sizes), topics)),
        })

    kind = blocks.schema["keys"].dataType.elementType.simpleString()
    schema = f"corpus string, `{key}` {kind}, mixture array<double>"
    return (
        blocks.drop("terms", "shelves")
        .groupBy("block")
        .cogroup(factors.groupBy("block"))
        .applyInArrow(mix, schema)
    )


def _beta(factors: pa.Table, topics: int) -> np.ndarray:
    """The factors of a block's terms by place, a row per topic, from its rows by shelf."""
    return np.ascontiguousarray(_values(factors["factors"]).reshape(-1, topics).T)


def _theta_of(gamma: np.ndarray) -> np.ndarray:
    """exp E[log topic share] of documents, a row per topic."""
    psi = digamma(np.vstack([gamma, gamma.sum(axis=0)]))
    return np.exp(psi[:-1] - psi[-1])


def _settled(weight: np.ndarray, beta: np.ndarray, sizes: np.ndarray, prior: float) -> np.ndarray:
    """Gamma, the variational topic weights of each document, a chunk of documents at a time.

    Every document settles for itself, so the chunks do not change the result. A chunk has documents
    of about the same size, filled up to the longest one with places of no weight."""
    starts, gamma = np.cumsum(sizes) - sizes, np.ones((len(beta), len(sizes)))
    order = np.argsort(sizes, kind="stable")
    lengths = sizes[order].astype(np.int64)
    alike = np.floor(SIZE_STEPS * np.log2(lengths)).astype(np.int64)
    chunk = (np.cumsum(lengths) - lengths) // CHUNK_TERMS
    edges = np.flatnonzero((np.diff(alike, prepend=-1) != 0) | (np.diff(chunk, prepend=-1) != 0))
    for first, last in zip(edges, [*edges[1:], len(order)]):
        documents, place = order[first:last], np.arange(lengths[last - 1])
        own = place < lengths[first:last, None]
        rows = starts[documents][:, None] + np.where(own, place, 0)
        held = np.ascontiguousarray(beta[:, rows].transpose(1, 0, 2))
        gamma[:, documents] = _settled_chunk(np.where(own, weight[rows], 0.0), held, prior)
    return gamma


def _settled_chunk(weight: np.ndarray, beta: np.ndarray, prior: float) -> np.ndarray:
    """Gamma of documents with a row of weights and a matrix of factors, a row per topic, each.

    Documents that have settled keep their gamma and are left out once they are a quarter."""
    settled = np.ones((beta.shape[1], len(weight)))
    gamma, live = settled.copy(), np.arange(len(weight))
    moving = np.ones(len(weight), dtype=bool)
    for _ in range(MIXTURE_STEPS):
        theta = _theta_of(gamma)
        share = np.matmul(np.ascontiguousarray(theta.T)[:, None], beta)[:, 0]
        share += TINY
        np.divide(weight, share, out=share)
        fresh = prior + theta * np.matmul(beta, share[:, :, None])[:, :, 0].T
        settled[:, live[moving]] = fresh[:, moving]
        moving &= np.abs(fresh - gamma).mean(axis=0) >= MIXTURE_TOLERANCE
        gamma = fresh
        if not moving.any():
            break
        if moving.mean() < 0.75:
            weight, beta, live, gamma = weight[moving], beta[moving], live[moving], gamma[:, moving]
            moving = moving[moving]
    return settled


def _gather_terms(given: DataFrame, names: Sequence[str]) -> DataFrame:
    """New term-topic weights by shelf: prior plus what all documents give to the term."""
    topics = len(names)

    def gather(given: pa.Table) -> pa.Table:
        given = given.sort_by("block")
        places = _values(given["places"])
        gained = _values(given["given"]).reshape(-1, topics).T
        weights = np.column_stack([np.bincount(places, weights=g) for g in gained]) + 1.0 / topics
        return _shelf(given["shelf"][0], weights, given["block"], _sizes(given["places"]), places)

    return given.groupBy("shelf").applyInArrow(gather, SHELF)


def _named(vocabulary: DataFrame, terms: DataFrame, names: Sequence[str]) -> DataFrame:
    """The topic weights of the terms by name: corpus, term, topic_0 .."""
    names = list(names)

    def name_terms(words: pa.Table, shelf: pa.Table) -> pa.Table:
        words = words.sort_by("term_id")
        weights = _values(shelf["weights"]).reshape(-1, len(names))
        masses = {name: np.ascontiguousarray(weights[:, i]) for i, name in enumerate(names)}
        return pa.table({**{name: words[name] for name in TERM_KEYS}, **masses})

    schema = "corpus string, term string, " + ", ".join(f"{n} double" for n in names)
    return (
        vocabulary.select("shelf", "term_id", *TERM_KEYS)
        .groupBy("shelf")
        .cogroup(terms.select("shelf", "weights").groupBy("shelf"))
        .applyInArrow(name_terms, schema)
    )


def topic_keywords(terms: DataFrame, topics: int = TOPICS, most: int = KEYWORDS) -> DataFrame:
    """The heaviest terms of every topic, heaviest first: corpus, topic, keywords.

    Masses are distributed sums, whose last digits may differ between runs: they are ranked
    rounded, then by term. Only terms that can reach a place are ranked, and the rank filter is
    applied in each task before the shuffle."""
    names = [f"topic_{i}" for i in range(topics)]
    by_mass = Window.partitionBy("corpus", "topic").orderBy(F.desc("mass"), "term")
    return (
        _contenders(terms, names, most)
        .withColumn("rank", F.row_number().over(by_mass))
        .where(F.col("rank") <= most)
        .groupBy("corpus", "topic")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("ranked"))
        .select(
            "corpus",
            "topic",
            F.transform("ranked", lambda r: F.replace(r["term"], F.lit(" "), F.lit("_"))).alias(
                "keywords"
            ),
        )
    )


def _contenders(terms: DataFrame, names: Sequence[str], most: int) -> DataFrame:
    """The terms that can be among the `most` heaviest of a topic: corpus, term, topic, mass.

    Terms are dealt to groups by hash. The heaviest of the groups are so many different terms,
    so the mass of the last of the first `most` of them is one that every kept term reaches.
    Fewer groups than that give no such mass, and all terms stay. A corpus has one row of masses."""
    masses = {name: F.round(name, RANKED_PLACES) for name in names}
    rounded = terms.select(*TERM_KEYS, *[mass.alias(name) for name, mass in masses.items()])
    least = (
        rounded.groupBy("corpus", F.pmod(F.xxhash64("term"), F.lit(RANKED_GROUPS)).alias("dealt"))
        .agg(*[F.max(name).alias(name) for name in names])
        .groupBy("corpus")
        .agg(*[
            F.get(F.sort_array(F.collect_list(name), asc=False), F.lit(most - 1)).alias(f"least_{name}")
            for name in names
        ])
        .withColumnRenamed("corpus", "of_corpus")
    )
    reached = [F.col(f"least_{n}").isNull() | (F.col(n) >= F.col(f"least_{n}")) for n in names]
    entries = [
        F.when(reach, F.struct(F.lit(i).alias("topic"), F.col(name).alias("mass")))
        for i, (name, reach) in enumerate(zip(names, reached))
    ]
    return (
        rounded.join(F.broadcast(least), F.col("corpus").eqNullSafe(F.col("of_corpus")))
        .where(reduce(or_, reached))
        .select(*TERM_KEYS, F.inline(F.filter(F.array(*entries), lambda e: e.isNotNull())))
    )
