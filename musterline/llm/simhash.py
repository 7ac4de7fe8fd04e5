"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most `radius` bits have a middle: a word within half the
radius of both. So every distinct fingerprint stands for all its variants within that half,
variants are brought together, and fingerprints that share one are linked.

A 64-bit fingerprint has 2,081 variants within two bits. They are not shuffled one by
one: variants are dealt by the value of a few chosen bits, and a row (value, fingerprint)
travels once per value that the fingerprint's variants take (56 rows for ten bits). The
receiving task forms the variants of its value, all of them, sorts them and links equal ones.

Defined cases: null, empty and blank texts have fingerprint zero and are linked like any other;
fewer words than a shingle make one shingle; a null id counts after all others when a
group's smallest id is taken; repeated rows and copies share one fingerprint; an empty table
gives an empty result; extra columns, whatever their names, pass through `deduplicate`.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from musterline.llm.common import by_value, kept, whole_rows
from musterline.llm.components import components
from musterline.operators.skew import add_split, copy_per_split, hot_keys

SEED = 42
# Fingerprints per value of the chosen bits, before variants: decides how many bits.
PER_VALUE = 256
MOST_BITS = 26
# Variants a task holds at once.
MOST_VARIANTS = 2_000_000
# Variants of one value beyond which they are formed by several tasks, and of how many values and by
# how many tasks at most; any further ones are formed in more parts, one after the other.
CROWDED = 32_000_000
MOST_CROWDED, MOST_SPLITS = 10_000, 256
# A component or a fingerprint with more rows than this (and a ten-thousandth of all) is split.
SPLIT_ROWS = 10_000
SPREAD = np.uint64(0x9E3779B97F4A7C15)
SLICE = 1 << 16

by_value(sys.modules[__name__])

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def fingerprint(text: str | None, shingle: int) -> int:
    """Majority of the bits of the shingles' XXH64 values, as a signed number."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(shingle, len(words))
    first, last = starts[: len(words) - size + 1], ends[size - 1 :]
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, len(first), SLICE):
        parts = zip(first[at : at + SLICE].tolist(), last[at : at + SLICE].tolist())
        packed = b"".join([digest(joined[i:j], SEED) for i, j in parts])
        bits = np.unpackbits(np.frombuffer(packed, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(first)).view(">i8")[0])


def fingerprint_of(text: str | Column, shingle: int = 4) -> Column:
    """The fingerprint of a text column as a long; one pass over Arrow batches."""

    @F.pandas_udf("long")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint(t, shingle) for t in batch.tolist()], dtype="int64")

    return made(F.col(text) if isinstance(text, str) else text)


def as_hex(number: Column) -> Column:
    return F.lower(F.lpad(F.hex(number), 16, "0"))


def flips(bits: list[int], most: int) -> np.ndarray:
    """All masks of at most `most` of these bits."""
    masks = [
        sum(1 << b for b in chosen) for n in range(most + 1) for chosen in combinations(bits, n)
    ]
    return np.array(masks, np.uint64)


def link_one_value(
    value: int, numbers: np.ndarray, chosen: int, half: int, split: int = 0, splits: int = 1
) -> np.ndarray:
    """Pairs (fingerprint, least of its group) among those with a variant of this value.

    A variant of the value keeps the chosen bits as `value` and flips at most what is left of
    `half` among the other bits. Variants are dealt into parts by a hash, at most about
    `MOST_VARIANTS` in each, and a split works off its share of the parts; equal variants are
    in one part, so parts and splits change no link.
    """
    numbers = np.unique(numbers.view(np.uint64))
    mask = np.uint64(chosen)
    left = half - np.bitwise_count((numbers & mask) ^ np.uint64(value)).astype(np.int64)
    low = numbers & ~mask
    others = [b for b in range(64) if not chosen >> b & 1]
    masks = [flips(others, n) for n in range(half + 1)]
    owned = [np.flatnonzero(left == n) for n in range(half + 1)]
    total = sum(len(own) * len(own_masks) for own, own_masks in zip(owned, masks))
    inner = max(1, math.ceil(total / splits / MOST_VARIANTS))
    parent = np.arange(len(numbers))
    for part in range(split * inner, (split + 1) * inner):
        keys, owners = [], []
        for own, own_masks in zip(owned, masks):
            step = max(1, MOST_VARIANTS // len(own_masks))
            for at in range(0, len(own), step):
                rows = own[at : at + step]
                made = (low[rows][:, None] ^ own_masks[None, :]).ravel()
                held = np.repeat(rows, len(own_masks))
                if splits * inner > 1:
                    place = (made * SPREAD) >> np.uint64(32)
                    here = place % np.uint64(splits * inner) == np.uint64(part)
                    made, held = made[here], held[here]
                keys.append(made)
                owners.append(held)
        if not keys:
            continue
        keys, owners = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(keys)
        same = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
        if not len(same):
            continue
        a, b = owners[order[same]], owners[order[same + 1]]
        pairs = np.unique(np.minimum(a, b) * len(numbers) + np.maximum(a, b))
        a, b = pairs // len(numbers), pairs % len(numbers)
        near = (a != b) & (np.bitwise_count(numbers[a] ^ numbers[b]) <= 2 * half)
        parent = join_groups(parent, a[near], b[near])
    own = np.flatnonzero(parent != np.arange(len(numbers)))
    return np.column_stack((numbers[own].view(np.int64), numbers[parent[own]].view(np.int64)))


def join_groups(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least number of every group after linking a with b; works on whole arrays."""
    while len(a):
        before = parent.copy()
        low = np.minimum(parent[a], parent[b])
        for side in (a, b):
            np.minimum.at(parent, before[side], low)
            np.minimum.at(parent, side, low)
        while (parent != parent[parent]).any():
            parent = parent[parent]
        if (parent == before).all():
            break
    return parent


def links_of(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """Links (a, b), b < a, that connect all `fingerprint`s within `radius` of each other.

    They span the same components as all pairs at that distance do; no group's pairs are
    written out.
    """
    if radius % 2 or not 0 <= radius <= 8:
        raise ValueError("the radius must be even, from 0 to 8")
    half = radius // 2
    figures = distinct.agg(
        F.count("*").alias("n"),
        *[
            F.sum(F.shiftright("fingerprint", b).bitwiseAND(F.lit(1))).alias(f"b{b}")
            for b in range(64)
        ],
    ).first()
    rows = figures["n"]
    bits = max(2, min(MOST_BITS, math.ceil(math.log2(max(1, rows) / PER_VALUE + 1))))
    # The bits that split the fingerprints most evenly.
    even = sorted(range(64), key=lambda b: (abs((figures[f"b{b}"] or 0) * 2 - rows), b))[:bits]
    chosen = sum(1 << b for b in even)
    signed = chosen - (1 << 64) if chosen >> 63 else chosen
    masks = F.array(*[F.lit(int(m)) for m in flips(even, half).view(np.int64)])
    dealt = distinct.select("fingerprint", F.explode(masks).alias("mask")).select(
        "fingerprint",
        "mask",
        F.col("fingerprint").bitwiseAND(F.lit(signed)).bitwiseXOR(F.col("mask")).alias("value"),
    )

    # A value with very many variants is worked off by several tasks; each gets all its
    # fingerprints and forms its part of their variants.
    others = 64 - bits
    variants = [sum(math.comb(others, k) for k in range(n + 1)) for n in range(half + 1)]
    weight = F.get(F.array(*map(F.lit, variants)), F.lit(half) - F.bit_count("mask"))
    counts = kept(
        dealt.groupBy("value").agg(F.sum(weight.cast("long")).alias("n")).where(F.col("n") > CROWDED)
    )
    splits = F.least(F.ceil(F.col("n") / CROWDED), F.lit(MOST_SPLITS)).cast("int")
    hot = counts.orderBy(F.desc("n"), "value").limit(MOST_CROWDED).select("value", splits.alias("splits"))
    spread = dealt.join(F.broadcast(hot), "value", "left").select(
        "fingerprint",
        "value",
        F.coalesce("splits", F.lit(1)).alias("splits"),
        F.explode(F.sequence(F.lit(0), F.coalesce("splits", F.lit(1)) - 1)).alias("split"),
    )

    def link(key: tuple, table: pa.Table) -> pa.Table:
        value = key[0].as_py() & ((1 << 64) - 1)
        numbers = table["fingerprint"].to_numpy()
        pairs = link_one_value(value, numbers, chosen, half, key[1].as_py(), key[2].as_py())
        wide, narrow = pairs.max(1), pairs.min(1)
        return pa.table({"a": pa.array(wide, pa.int64()), "b": pa.array(narrow, pa.int64())})

    found = spread.groupBy("value", "split", "splits").applyInArrow(link, "a long, b long")
    return found.distinct()


def groups(rows: DataFrame, radius: int = 4) -> DataFrame:
    """(fingerprint, first, n) per distinct fingerprint: the first (id, text hash) of its group
    and the number of rows with it.

    `rows` has doc_id, text_hash and fingerprint and should be cheap to read twice.
    """
    key = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_hash")
    distinct = kept(
        rows.groupBy("fingerprint").agg(F.min(key).alias("first"), F.count("*").alias("n"))
    )
    roots = components(links_of(distinct.select("fingerprint"), radius))
    rooted = distinct.join(
        roots.withColumnRenamed("a", "fingerprint"), "fingerprint", "left"
    ).withColumn("root", F.coalesce("root", "fingerprint"))
    first = kept(
        rooted.groupBy("root").agg(F.min("first").alias("first"), F.count("*").alias("members"))
    )
    # One component may hold a large part of all fingerprints.
    hot = hot_keys(first.select("root", "members"), ["root"], "members", SPLIT_ROWS)
    own = add_split(rooted.select("fingerprint", "root", "n"), hot, ["root"], "fingerprint")
    return own.join(
        copy_per_split(first.drop("members"), hot, ["root"]), ["root", "split"]
    ).select("fingerprint", "first", "n")


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, hash of the text and fingerprint of every row, written to the shared folder."""
    return kept(
        docs.select(
            F.col("doc_id"),
            F.xxhash64("text").alias("text_hash"),
            fingerprint_of("text", shingle).alias("fingerprint"),
        )
    )


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every row.

    The component's id is the smallest doc_id among documents reachable over links.
    """
    rows = fingerprints(docs, shingle)
    found = kept(groups(rows, radius))
    # One fingerprint, such as that of empty texts, may be that of very many rows.
    hot = hot_keys(found.select("fingerprint", "n"), ["fingerprint"], "n", SPLIT_ROWS)
    single = copy_per_split(found.drop("n"), hot, ["fingerprint"])
    dealt = add_split(rows, hot, ["fingerprint"], "text_hash")
    return dealt.join(single, ["fingerprint", "split"]).select(
        "doc_id",
        as_hex(F.col("fingerprint")).alias("fingerprint"),
        F.col("first.doc_id").alias("component_id"),
    )


def deduplicate(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """The first row of each group, with the columns of `docs`.

    First is the smallest doc_id, then the smallest text hash; of rows that agree in both,
    any one stays. Texts are shuffled once, by doc_id and text hash.
    """
    chosen = (
        groups(fingerprints(docs, shingle), radius)
        .select(
            F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash")
        )
        .distinct()
    )
    rows = whole_rows(docs, id="doc_id", text_hash=F.xxhash64("text"))
    same = rows["id"].eqNullSafe(chosen["first_id"]) & (rows["text_hash"] == chosen["first_hash"])
    return (
        rows.join(chosen, same, "left_semi").dropDuplicates(["id", "text_hash"]).select("row.*")
    )
