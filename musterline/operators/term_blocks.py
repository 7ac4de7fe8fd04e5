"""TF-IDF of documents in blocks: their terms are never rows of a shuffle.

The terms of a document are several times its text, and most pairs of words come once. So a block
keeps its distinct words once and its tokens as numbers. It sends each of its distinct terms to the
term's shelf once, packed with all others that go there. A shelf adds up the documents of its terms
and answers every block in the block's own order, so the answers are bare numbers. Blocks and shelves
are bounded whatever the data.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

# Tokens of a block, unless a single document has more: bounds the memory of its arrays in a Python
# worker. The more, the fewer blocks share a term.
BLOCK_TOKENS = 1 << 19
# Terms of a shelf, counted once per block. The more, the better they pack.
SHELF_TERMS = 1 << 21
# Rows handed back to Spark at once.
OUT_ROWS = 1 << 16
# The packed columns are read once or twice, so some effort pays.
LEVEL = 6

# A block's number is that of its task, then so many bits.
TASK_BITS = 32
BLOCK = (
    "block long, corpus string, whole boolean, tokens long, keys binary, sizes binary,"
    " times binary, places binary, spans binary, letters binary"
)
OPENED = ["block", "corpus", "whole", "sizes", "times", "places", "spans", "letters"]

# Python workers get the functions by value and need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def cut_into_blocks(rows: DataFrame) -> DataFrame:
    """Blocks of `rows` (corpus, key, tokens, times, whole) that have tokens, where the rows lie.

    The terms of a row count `times` over. A block has rows of one corpus, and either only `whole` ones
    or none.
    """
    return rows.mapInArrow(_cut, BLOCK)


def task_of(block: str) -> Column:
    """The task that cut a block, from the block's number."""
    return F.shiftright(block, TASK_BITS)


def kept_by_blocks(
    blocks: DataFrame,
    sized: Callable[[DataFrame], DataFrame],
    shelves: int,
    tasks: int,
    min_docs: int,
    max_share: float,
) -> DataFrame:
    """For every block the numbers of documents of its kept terms, shelf by shelf, 0 for the others.

    `sized` adds the number of documents of the corpus to a frame, as `docs`. Blocks that lie in fewer
    `tasks` than can run at once are dealt out first.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                yield from _spread(row, shelves)

    def shelve(table: pa.Table) -> pa.Table:
        return _shelve(table, min_docs, max_share)

    session = blocks.sparkSession
    opened = blocks.select(*OPENED)
    if tasks < session.sparkContext.defaultParallelism:
        opened = opened.repartition(int(session.conf.get("spark.sql.shuffle.partitions")), "block")
    sent = opened.mapInArrow(
        spread, "corpus string, shelf int, block long, spans binary, letters binary, holders binary"
    )
    found = sized(sent).groupBy("corpus", "shelf").applyInArrow(shelve, "block long, shelf int, found binary")
    return found.groupBy("block").agg(F.collect_list(F.struct("shelf", "found")).alias("answers"))


def shelves_for(blocks: DataFrame, tokens: int) -> int:
    """How many shelves the terms of so many tokens fill; a token makes two terms at most."""
    least = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-2 * tokens // SHELF_TERMS))


def weigh(answered: DataFrame, key: StructField, shelves: int) -> DataFrame:
    """Corpus, key, term, tf, df and weight of the kept terms of blocks with their `answers` and `docs`.

    The weights of a `whole` row have unit length, all others are as before that.
    """
    schema = StructType(
        [
            StructField("corpus", StringType()),
            key,
            StructField("term", StringType()),
            StructField("tf", LongType()),
            StructField("df", LongType()),
        ]
    ).add("weight", "double")
    names = schema.names

    def open_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                yield from _weigh(row, shelves, names)

    return answered.select(*OPENED, "keys", "answers", "docs").mapInArrow(open_blocks, schema)


# --- blocks ---


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a task in blocks, numbered by the task and their order in it."""
    number, waiting = TaskContext.get().partitionId() << TASK_BITS, {}
    for batch in batches:
        for kind, own in _kinds(pa.Table.from_batches([batch])):
            parts, held = waiting.pop(kind, ([], 0))
            sizes = pc.list_value_length(own["tokens"]).to_numpy().astype(np.int64)
            # A block ends with the row that fills it.
            ends = held + np.cumsum(sizes)
            turns = (ends - sizes) // BLOCK_TOKENS
            for turn in range(int(turns[-1]) + 1):
                first, last = np.searchsorted(turns, [turn, turn + 1])
                if first == last:
                    continue
                if turn and parts:
                    yield _packed_block(number, *kind, pa.concat_tables(parts))
                    number, parts = number + 1, []
                parts = [*parts, own.slice(first, last - first)]
                held = int(ends[last - 1]) - turn * BLOCK_TOKENS
            waiting[kind] = (parts, held)
    for kind, (parts, _) in waiting.items():
        yield _packed_block(number, *kind, pa.concat_tables(parts))
        number += 1


def _kinds(rows: pa.Table) -> Iterator[tuple[tuple[str, bool], pa.Table]]:
    """The rows with tokens by corpus and `whole`."""
    filled = pc.greater(pc.fill_null(pc.list_value_length(rows["tokens"]), 0), 0)
    for corpus in rows["corpus"].unique().to_pylist():
        for whole in rows["whole"].unique().to_pylist():
            own = pc.and_(pc.equal(rows["corpus"], corpus), pc.equal(rows["whole"], whole))
            own = pc.and_(own, filled)
            if pc.any(own).as_py():
                yield (corpus, whole), rows if pc.all(own).as_py() else rows.filter(own)


def _packed_block(number: int, corpus: str, whole: bool, rows: pa.Table) -> pa.RecordBatch:
    """The words of a block in order, and its tokens as their places."""
    lists = rows["tokens"].combine_chunks()
    coded = lists.flatten().cast(pa.large_string()).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    places = np.empty(len(order), np.int32)
    places[order] = np.arange(len(order), dtype=np.int32)
    spans, letters = _packed_strings(coded.dictionary.take(pa.array(order)))
    values = [
        number,
        corpus,
        whole,
        len(coded),
        _packed_column(rows.column(1).combine_chunks()),
        _packed(pc.list_value_length(lists).to_numpy().astype(np.int32)),
        _packed(rows["times"].to_numpy().astype(np.int64)),
        _packed(places[coded.indices.to_numpy()]),
        spans,
        letters,
    ]
    names = [field.split()[0] for field in BLOCK.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.bool_(), pa.int64(), *[pa.binary()] * 6]
    return pa.RecordBatch.from_arrays(
        [pa.array([value], kind) for value, kind in zip(values, kinds, strict=True)], names
    )


def _opened(row: dict) -> tuple[pa.LargeStringArray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct terms of a block and their hashes; then row, term and count of each term of a row."""
    words, sizes = _strings(row["spans"], row["letters"]), _unpacked(row["sizes"], np.int32)
    places, times = _unpacked(row["places"], np.int32).astype(np.int64), _unpacked(row["times"], np.int64)
    owner = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    pairs = owner[1:] == owner[:-1]
    codes = (places[:-1] * len(words) + places[1:])[pairs]
    codes, coded = np.unique(codes, return_inverse=True)
    one, two = np.divmod(codes, len(words))
    spaced = pc.match_substring(words, " ")
    hashes, steps = _hashed(words, spaced)
    space = pa.scalar(" ", words.type)
    joined = pc.binary_join_element_wise(words.take(pa.array(one)), words.take(pa.array(two)), space)
    terms = pa.concat_arrays([words, joined])
    with np.errstate(over="ignore"):
        hashes = np.concatenate([hashes, hashes[one] * steps[two] + hashes[two]])
    owner, term = np.concatenate([owner, owner[1:][pairs]]), np.concatenate([places, coded + len(words)])
    if pc.any(spaced).as_py():
        # A word with a space in it can be the same term as a pair of words.
        same = terms.dictionary_encode()
        terms, place = same.dictionary, same.indices.to_numpy()
        term, own = place[term], np.empty(len(terms), np.uint64)
        own[place] = hashes
        hashes = own
    met, counts = np.unique(owner * len(terms) + term, return_counts=True)
    owner, term = np.divmod(met, len(terms))
    return terms, hashes, owner, term, counts * times[owner]


def _hashed(words: pa.LargeStringArray, spaced: pa.BooleanArray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word, and the factor of what stands before it in a term.

    The hash of a term is that of the pieces between its spaces one after another, however they
    came together.
    """
    given = words.to_pylist()
    hashes = np.fromiter(map(zlib.crc32, map(str.encode, given)), np.uint64, len(given))
    hashes, steps = hashes * HASH, np.full(len(given), STEP)
    for place in np.flatnonzero(spaced.to_numpy(zero_copy_only=False)):
        whole, step = 0, 1
        for piece in given[place].split(" "):
            whole = (whole * int(STEP) + zlib.crc32(piece.encode()) * int(HASH)) % (1 << 64)
            step = step * int(STEP) % (1 << 64)
        hashes[place], steps[place] = whole, step
    return hashes, steps


# Odd numbers of 64 bits.
HASH, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def _by_shelf(hashes: np.ndarray, shelves: int) -> tuple[np.ndarray, np.ndarray]:
    """The terms in the order of their shelves, else in their own, and where each shelf begins."""
    mixed = hashes ^ (hashes >> np.uint64(29))
    with np.errstate(over="ignore"):
        shelf = ((mixed * HASH) >> np.uint64(32)) % np.uint64(shelves)
    order = np.argsort(shelf, kind="stable")
    return order, np.searchsorted(shelf[order], np.arange(shelves + 1))


# --- shelves ---


def _spread(row: dict, shelves: int) -> Iterator[pa.RecordBatch]:
    """The distinct terms of a block and how many of its rows hold them, packed by shelf."""
    terms, hashes, _, term, _ = _opened(row)
    order, starts = _by_shelf(hashes, shelves)
    holders = np.bincount(term, minlength=len(terms))[order]
    terms = terms.take(pa.array(order))
    used = np.flatnonzero(starts[1:] > starts[:-1])
    spans, letters = zip(*[_packed_strings(terms[starts[s] : starts[s + 1]]) for s in used], strict=True)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([row["corpus"]] * len(used), pa.string()),
            pa.array(used, pa.int32()),
            pa.array([row["block"]] * len(used), pa.int64()),
            pa.array(spans, pa.binary()),
            pa.array(letters, pa.binary()),
            pa.array([_packed(holders[starts[s] : starts[s + 1]]) for s in used], pa.binary()),
        ],
        ["corpus", "shelf", "block", "spans", "letters", "holders"],
    )


def _shelve(table: pa.Table, min_docs: int, max_share: float) -> pa.Table:
    """Adds up the documents of every term of a shelf and answers each block in its own order."""
    parts = [
        _strings(spans, letters)
        for spans, letters in zip(table["spans"].to_pylist(), table["letters"].to_pylist(), strict=True)
    ]
    holders = [_unpacked(x, np.int64) for x in table["holders"].to_pylist()]
    place = pa.concat_arrays(parts).dictionary_encode().indices.to_numpy()
    df = np.bincount(place, weights=np.concatenate(holders)).astype(np.int64)
    docs = table["docs"][0].as_py()
    df[(df < min_docs) | (df > docs * max_share)] = 0
    found = np.split(df[place], np.cumsum([len(part) for part in parts])[:-1])
    return pa.Table.from_arrays(
        [table["block"], table["shelf"], pa.array([_packed(x) for x in found], pa.binary())],
        ["block", "shelf", "found"],
    )


def _weigh(row: dict, shelves: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    terms, hashes, owner, term, tf = _opened(row)
    order, starts = _by_shelf(hashes, shelves)
    df = np.zeros(len(terms), np.int64)
    for answer in row["answers"]:
        own = order[starts[answer["shelf"]] : starts[answer["shelf"] + 1]]
        df[own] = _unpacked(answer["found"], np.int64)
    kept = df[term] > 0
    owner, term, tf = owner[kept], term[kept], tf[kept]
    weight = tf * (np.log((row["docs"] + 1) / (df + 1)) + 1)[term]
    if row["whole"]:
        weight /= np.sqrt(np.bincount(owner, weights=weight * weight))[owner]
    keys = _column(row["keys"])
    for start in range(0, len(owner), OUT_ROWS):
        own = slice(start, start + OUT_ROWS)
        arrays = [
            pa.array([row["corpus"]] * len(owner[own]), pa.string()),
            keys.take(pa.array(owner[own])),
            terms.take(pa.array(term[own])).cast(pa.string()),
            pa.array(tf[own], pa.int64()),
            pa.array(df[term[own]], pa.int64()),
            pa.array(weight[own], pa.float64()),
        ]
        yield pa.RecordBatch.from_arrays(arrays, names)


# --- packed columns ---


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for place in range(batch.num_rows):
        yield {name: batch[name][place].as_py() for name in batch.schema.names}


def _squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", LEVEL).compress(data, asbytes=True)


def _restored(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return pa.Codec("zstd").decompress(data[8:], decompressed_size=size, asbytes=True)


def _packed(numbers: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones, and so on: the high ones are alike."""
    numbers = np.ascontiguousarray(numbers)
    return _squeezed(numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T.tobytes())


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(_restored(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _packed_strings(strings: pa.LargeStringArray) -> tuple[bytes, bytes]:
    """Their lengths in bytes, and the bytes."""
    _, offsets, data = strings.buffers()
    ends = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    letters = data[int(ends[0]) : int(ends[-1])].to_pybytes() if data else b""
    return _packed(np.diff(ends).astype(np.int32)), _squeezed(letters)


def _strings(spans: bytes, letters: bytes) -> pa.LargeStringArray:
    ends = np.concatenate([[0], np.cumsum(_unpacked(spans, np.int32), dtype=np.int64)])
    return pa.LargeStringArray.from_buffers(
        len(ends) - 1, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(_restored(letters))
    )


def _packed_column(column: pa.Array | pa.ChunkedArray) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_arrays([column], ["key"])
    with pa.ipc.new_stream(sink, table.schema) as stream:
        stream.write_table(table)
    return _squeezed(sink.getvalue().to_pybytes())


def _column(data: bytes) -> pa.Array:
    return pa.ipc.open_stream(_restored(data)).read_all().column(0).combine_chunks()
