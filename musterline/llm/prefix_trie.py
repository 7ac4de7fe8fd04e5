"""Conversation prefix trie by depth-band rollup.

A node is a distinct sequence of first turns. Its key is an exclusive-or of 64-bit hashes of
its turns, each hashed with its depth, in two halves (128 bits), so keys of all depths
are running values along a conversation and no text is shuffled again.

Totals over subtrees are rolled up by bands of `height` depths. Every node adds its figures to
its ancestors inside its band only, at most `height` of them. The totals of band roots are then
a smaller problem of the same kind, on the tree of the band roots, and are solved by the
same step; the completed totals are added to the nodes of the band above. A trie of depth
d takes log(d) / log(height) rounds, and a round writes at most `height` rows per node.

No conversation and no node is gathered whole: turns are numbered along a range sort, running
keys are formed in blocks of `BLOCK` turns, members and sums are merged before they are
shuffled, and parents with very many children are split. The hash over a node's members is
fed in order by one task, in runs of at most 2**RUN_BITS ids; it holds one run at a time.

Defined cases: rows with a null conversation id belong to no conversation; null role and text are
empty; a null turn comes first; turns of equal number are ordered by role, then text;
repeated rows are turns of their own; an empty table has no root and gives an empty result;
other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from musterline.llm.common import by_value, kept
from musterline.operators.skew import add_split, copy_per_split, hot_keys

HEIGHT = 16
BLOCK = 1024
RUN_BITS = 12
# A parent with more children than this (and a hundredth of a percent of all) is split.
MANY_CHILDREN = 4096

KEY = ["ka", "kb"]

by_value(sys.modules[__name__])


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv, at, ma, mb, bytes of every turn: `at` rises along a conversation, written down.

    `at` is the partition of a range sort and the row's place in it.
    """
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return kept(
        ordered.select(
            "conv",
            F.monotonically_increasing_id().alias("at"),
            F.xxhash64(F.lit("a"), "role", "text").alias("ma"),
            F.xxhash64(F.lit("b"), "role", "text").alias("mb"),
            F.octet_length("text").cast("long").alias("bytes"),
        )
    )


def shared_openings(conversations: DataFrame, group: int = 5, most: int = 8) -> DataFrame:
    """The turns of every conversation c after it took over its opening from c - c % group.

    The opening is the first h turns of that conversation, h = crc32(decimal c) % (most + 1),
    and c's own turns after its first h follow. Gives conv, depth (from 0, the root),
    length, ma, mb, bytes.
    """
    turns = numbered_turns(conversations)
    span = F.shiftright("at", 33)
    # One row per conversation and partition of the range sort that it touches.
    spans = turns.groupBy("conv", span.alias("span")).agg(
        F.min("at").alias("first"), F.count("*").alias("n")
    )
    before = W.partitionBy("conv").orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    spans = kept(
        spans.withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1)
    )
    size = spans.groupBy("conv").agg(F.sum("n").alias("turns"))
    head = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(most + 1))
    bases = size.select(F.col("conv").alias("base"), F.col("turns").alias("base_turns"))
    lengths = kept(
        size.withColumns({"head": head, "base": F.col("conv") - F.col("conv") % group})
        .join(bases, "base", "left")
        .withColumn("opening", F.least("head", F.coalesce("base_turns", F.lit(0))))
        .withColumn(
            "length", F.col("opening") + F.greatest(F.col("turns") - F.col("head"), F.lit(0))
        )
        .select("conv", "base", "head", "opening", "length")
    )
    placed = turns.withColumn("span", span).join(
        spans.join(lengths, "conv").select(
            "conv", "span", "shift", "head", "opening", "length"
        ),
        ["conv", "span"],
    ).withColumn("position", F.col("at") + F.col("shift"))
    own = placed.where("position > head").select(
        "conv", (F.col("position") - F.col("head") + F.col("opening")).alias("depth"),
        "length", "ma", "mb", "bytes",
    )
    openings = placed.where((F.col("position") <= most) & (F.col("conv") % group == 0)).select(
        F.col("conv").alias("base"), "position", "ma", "mb", "bytes"
    )
    taken = (
        lengths.join(openings, "base")
        .where("position <= opening")
        .select("conv", F.col("position").alias("depth"), "length", "ma", "mb", "bytes")
    )
    zero = F.lit(0).cast("long")
    roots = lengths.select(
        "conv", zero.alias("depth"), "length", zero.alias("ma"), zero.alias("mb"), zero.alias("bytes")
    )
    return own.unionByName(taken).unionByName(roots)


def keyed(paths: DataFrame) -> DataFrame:
    """conv, depth, bytes, last and the node key (ka, kb) of every step of a path, written down."""
    salted = paths.select(
        "conv",
        "depth",
        "bytes",
        (F.col("depth") == F.col("length")).alias("last"),
        (F.col("length") >= BLOCK).alias("long"),
        F.floor(F.col("depth") / BLOCK).alias("block"),
        F.when(F.col("depth") > 0, F.xxhash64("depth", "ma")).otherwise(0).alias("ma"),
        F.when(F.col("depth") > 0, F.xxhash64("mb", "depth")).otherwise(0).alias("mb"),
    )
    inside = (
        W.partitionBy("conv", "block").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    )
    running = salted.withColumns(
        {"ra": F.bit_xor("ma").over(inside), "rb": F.bit_xor("mb").over(inside)}
    )
    # What the earlier blocks of a long conversation add.
    before = W.partitionBy("conv").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        salted.where("long")
        .groupBy("conv", "block")
        .agg(F.bit_xor("ma").alias("xa"), F.bit_xor("mb").alias("xb"))
        .select(
            "conv", "block", F.bit_xor("xa").over(before).alias("ca"),
            F.bit_xor("xb").over(before).alias("cb"),
        )
    )
    zero = F.lit(0).cast("long")
    return kept(
        running.join(carried, ["conv", "block"], "left").select(
            "conv",
            "depth",
            "bytes",
            "last",
            F.col("ra").bitwiseXOR(F.coalesce("ca", zero)).alias("ka"),
            F.col("rb").bitwiseXOR(F.coalesce("cb", zero)).alias("kb"),
        )
    )


def _with_ancestors(nodes: DataFrame, steps: DataFrame, height: int) -> DataFrame:
    """Adds `above`, the keys of a node's ancestors in its band, the band root first.

    `steps` has conv, step, ka, kb. A band holds the steps after its root up to the next.
    """
    entry = F.struct("step", *KEY).alias("entry")
    band = F.floor((F.col("step") - 1) / height)
    inner = steps.where("step > 0").select("conv", band.alias("band"), entry)
    tops = steps.where(F.col("step") % height == 0).select(
        "conv", F.floor(F.col("step") / height).alias("band"), entry
    )
    bands = (
        inner.unionAll(tops)
        .groupBy("conv", "band")
        .agg(F.array_sort(F.collect_list("entry")).alias("path"))
    )
    placed = nodes.withColumn("band", band)
    own = (F.col("step") - F.col("band") * height).cast("int")
    return (
        placed.where("step > 0")
        .join(bands, ["conv", "band"])
        .withColumn("above", F.slice("path", F.lit(1), own))
        .drop("band", "path")
    )


def _added(rows: DataFrame, figures: list[str]) -> DataFrame:
    """The figures of all rows summed over the keys in `above`."""
    spread = rows.select(F.explode("above").alias("to"), *figures)
    return spread.groupBy(F.col("to.ka").alias("ka"), F.col("to.kb").alias("kb")).agg(
        *[F.sum(name).alias(name) for name in figures]
    )


def below(
    linked: DataFrame, steps: DataFrame, figures: list[str], deepest: int, height: int
) -> DataFrame:
    """(ka, kb, *figures): sums over all nodes strictly below a node; leaves have no row.

    `linked` is the result of `_with_ancestors` with the figures, without the root.
    """
    near = _added(linked, figures)
    if deepest <= height:
        return near
    near = kept(near)
    # Band roots are the next tree; what lies in a root's band is its weight there.
    tops = linked.where(F.col("step") % height == 0).select(
        "conv", "step", *KEY, F.col("above").alias("near_above")
    )
    weighed = tops.join(near, KEY, "left").withColumns(
        {name: F.coalesce(name, F.lit(0)) for name in figures}
    )
    scaled = steps.where(F.col("step") % height == 0).withColumn(
        "step", F.floor(F.col("step") / height)
    )
    weighed = weighed.withColumn("step", F.floor(F.col("step") / height))
    up = kept(_with_ancestors(weighed, scaled, height))
    deep = below(up, scaled, figures, deepest // height, height)
    complete = (
        up.select(*KEY, F.col("near_above").alias("above"), *figures)
        .unionByName(
            deep.join(up.select(*KEY, F.col("near_above").alias("above")), KEY).select(
                *KEY, "above", *figures
            )
        )
    )
    return near.unionByName(_added(complete, figures)).groupBy(*KEY).agg(
        *[F.sum(name).alias(name) for name in figures]
    )


def ends_digest(ends: DataFrame) -> DataFrame:
    """(ka, kb, ends_sha256): SHA-256 of a node's `conv` ids, ascending, comma-joined."""
    runs = (
        ends.groupBy(*KEY, F.shiftright("conv", RUN_BITS).alias("run"))
        .agg(F.array_sort(F.collect_list("conv")).alias("ids"))
        .select(*KEY, "run", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
        .repartition(*KEY)
        .sortWithinPartitions(*KEY, "run")
    )

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done: list[tuple] = []
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for own, ids in zip(zip(a, b), batch.column(3).to_pylist()):
                if own == key:
                    state.update(b"," + ids.encode())
                    continue
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = own, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(names, row)) for row in done], out)
        if key is not None:
            row = dict(zip(names, (*key, state.hexdigest())))
            yield pa.RecordBatch.from_pylist([row], out)

    names = ["ka", "kb", "ends_sha256"]
    out = pa.schema([("ka", pa.int64()), ("kb", pa.int64()), ("ends_sha256", pa.string())])
    return runs.mapInArrow(digests, "ka long, kb long, ends_sha256 string")


def _or_zero(name: str) -> Column:
    return F.coalesce(name, F.lit(0)).cast("long")


def trie(paths: DataFrame, height: int = HEIGHT) -> DataFrame:
    """One row per node of the trie over `paths` (conv, depth from 0, length, ma, mb, bytes).

    ka, kb (the key), conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (bytes of last turns that members share, over the subtree),
    ends_sha256 (of the members that end in the node).
    """
    steps = keyed(paths)
    nodes = steps.groupBy(*KEY).agg(
        F.min("conv").alias("conv"),
        F.min("depth").alias("step"),
        F.count("*").alias("n_convs"),
        F.max("bytes").alias("bytes"),
    )
    steps_only = steps.select("conv", F.col("depth").alias("step"), *KEY)
    nodes = kept(nodes)
    parent = F.element_at("above", -1)
    linked = kept(
        _with_ancestors(nodes, steps_only, height).withColumns(
            {"pa": parent["ka"], "pb": parent["kb"]}
        )
    )
    children = kept(linked.groupBy("pa", "pb").agg(F.count("*").alias("n_children")))
    counted = children.select(F.col("pa").alias("ka"), F.col("pb").alias("kb"), "n_children")
    saved = (F.col("n_convs") - 1) * F.col("bytes")
    weighed = kept(
        linked.join(counted, KEY, "left").withColumns(
            {
                "leaves": F.col("n_children").isNull().cast("long"),
                "saved": saved,
                "n_children": _or_zero("n_children"),
            }
        )
    )
    deepest = nodes.agg(F.max("step").alias("d")).first()["d"] or 0
    sums = below(
        weighed.select("conv", "step", *KEY, "above", "leaves", "saved"),
        steps_only, ["leaves", "saved"], deepest, height,
    )
    # Every node but the root learns its parent's smallest member.
    hot = hot_keys(children, ["pa", "pb"], "n_children", MANY_CHILDREN)
    named = nodes.join(counted, KEY, "left_semi").select(
        F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv").alias("parent_conv_id")
    )
    below_root = (
        add_split(weighed, hot, ["pa", "pb"], "ka")
        .join(copy_per_split(named, hot, ["pa", "pb"]), ["pa", "pb", "split"])
        .select("conv", "step", *KEY, "n_convs", "n_children", "leaves", "saved", "parent_conv_id")
    )
    root = nodes.where("step = 0").join(counted, KEY, "left").select(
        "conv", "step", *KEY, "n_convs", _or_zero("n_children").alias("n_children"),
        F.col("n_children").isNull().cast("long").alias("leaves"),
        F.lit(0).cast("long").alias("saved"), F.lit(None).cast("long").alias("parent_conv_id"),
    )
    under = sums.select(*KEY, F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved"))
    nothing = hashlib.sha256(b"").hexdigest()
    return (
        below_root.unionByName(root)
        .join(under, KEY, "left")
        .join(ends_digest(steps.where("last").select("conv", *KEY)), KEY, "left")
        .select(
            *KEY,
            F.col("conv").alias("conv_id"),
            F.col("step").alias("depth"),
            "parent_conv_id",
            "n_convs",
            "n_children",
            (F.col("leaves") + _or_zero("more_leaves")).alias("n_leaves"),
            (F.col("saved") + _or_zero("more_saved")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
        )
    )
