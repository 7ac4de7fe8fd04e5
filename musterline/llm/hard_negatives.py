"""Hard negatives by cover trees over norm-augmented candidates (see `cover_tree`).

Rows of equal label and vector are one candidate with its smallest ids: no further copy can be among
the first. Candidates are dealt into blocks, each block becomes a cover tree in one task, and the
anchors are brought to the blocks in parts.

* Positives: blocks of one label, split by hash where a label has many candidates.
* Negatives: blocks around pivots. A pivot and the largest distance to it are the top level of the
  tree: an anchor goes only to the pivots whose bounds meet one of its windows.

A block holds about 8 sqrt(n) candidates, between 1,024 and 65,536, a part at most `PART` anchors. Of
the corpus only the pivots (at most `PIVOTS`, with a radius each) reach the driver. Every tree
search is exact, so the results are those of comparing all anchors with all rows.

Defined cases: rows with a null id, label or vector, or a null or non-finite component, take no part;
components are whole numbers held within the range of a long, and so are scores in the result;
shorter vectors count as zero beyond their end; an empty vector scores 0 with everything; rows
equal in id, label and vector count once; rows with the anchor's id are never its positives or
negatives; ties go to the smaller id; an empty table gives an empty result; other columns are
not looked at, whatever their names.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from musterline.llm import cover_tree
from musterline.llm.common import by_value, kept, send
from musterline.operators.skew import add_split, copy_per_split, hot_keys

LEAST_BLOCK, MOST_BLOCK = 1_024, 65_536
PART = 16_384
PIVOTS = 512
# Hot labels and hot pivots that may be listed.
SHARES = 100_000
LONGEST = (1 << 63) - 1

by_value(sys.modules[__name__], cover_tree)


def whole_vectors(rows: DataFrame, vec: str, scale: float = 256.0) -> Column:
    """floor(scale * x) of every component; null if one of them is null or not finite."""
    bad = F.exists(
        F.col(vec), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    )
    whole = F.transform(F.col(vec), lambda x: F.floor(x.cast("double") * F.lit(scale)))
    return F.when(F.col(vec).isNotNull() & ~bad, whole)


def matrix(column: pa.ChunkedArray | pa.Array, width: int | None = None) -> np.ndarray:
    """Lists of whole numbers as rows, padded with zeros, cut or widened to `width`."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.list_(pa.int64()))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    longest = int(sizes.max(initial=0))
    if len(sizes) and (sizes == longest).all():
        made = flat.reshape(len(sizes), longest)
    else:
        made = np.zeros((len(sizes), longest), np.int64)
        made[np.arange(longest)[None, :] < sizes[:, None]] = flat
    if width is None or width == longest:
        return made
    more = np.zeros((len(made), width), np.int64)
    more[:, : min(width, longest)] = made[:, :width]
    return more


def window_of(score: int, low: int, high: int) -> tuple[int, int]:
    """Whole scores between `low` and `high` hundredths of a positive's; may be empty."""
    return -(-score * low // 100), score * high // 100


def _within(number: int) -> int:
    return max(-LONGEST - 1, min(LONGEST, number))


def _most(points: np.ndarray) -> int:
    return int(abs(points.astype(object)).max()) if points.size else 0


def _searched(
    points: pa.Table, anchors: pa.Table, same: bool, take: int, low: int = 0, high: int = 0
) -> Iterator[tuple[int, list, list]]:
    """(row of the anchor, windows, what each found) for the anchors of one block."""
    own = matrix(points["vec"])
    queries = matrix(anchors["vec"])
    width = max(own.shape[1], queries.shape[1])
    own, queries = matrix(points["vec"], width), matrix(anchors["vec"], width)
    tree = cover_tree.build(own, _most(queries))
    labels = points["label"].to_numpy()
    ids = points["ids"].to_pylist()
    windows = anchors["windows"].to_pylist() if "windows" in anchors.column_names else None
    for row, (anchor, label) in enumerate(
        zip(anchors["anchor"].to_pylist(), anchors["label"].to_pylist())
    ):
        held, spans = None, [(-math.inf, math.inf)]
        if windows is not None:
            spans = [window_of(w["positive_score"], low, high) for w in windows[row]]
            held = [w for w, (least, most) in zip(windows[row], spans) if least <= most]
            spans = [s for s in spans if s[0] <= s[1]]
        allowed = labels == label if same else labels != label
        if spans and allowed.any():
            found = cover_tree.search(tree, queries[row], allowed, ids, anchor, spans, take)
            yield row, held, found


def _positives_of(take: int):
    def run(_, points: pa.Table, anchors: pa.Table) -> pa.Table:
        out = {"row": [], "positive_id": [], "positive_score": []}
        for row, _, (best,) in _searched(points, anchors, True, take):
            for score, found in best:
                out["row"].append(row)
                out["positive_id"].append(found)
                out["positive_score"].append(_within(score))
        return _with_anchor(anchors, out)

    return run


def _negatives_of(take: int, low: int, high: int):
    def run(_, points: pa.Table, anchors: pa.Table) -> pa.Table:
        out = {"row": [], "positive_id": [], "positive_score": [], "negative_id": [], "negative_score": []}
        for row, windows, found in _searched(points, anchors, False, take, low, high):
            for window, best in zip(windows, found):
                for score, negative in best:
                    out["row"].append(row)
                    out["positive_id"].append(window["positive_id"])
                    out["positive_score"].append(window["positive_score"])
                    out["negative_id"].append(negative)
                    out["negative_score"].append(_within(score))
        return _with_anchor(anchors, out)

    return run


def _with_anchor(anchors: pa.Table, out: dict) -> pa.Table:
    rows = pa.array(out.pop("row"), pa.int64())
    named = {name: anchors[name].take(rows) for name in ("anchor", "key")}
    return pa.table(named | {name: pa.array(values, pa.int64()) for name, values in out.items()})


def _in_parts(points: DataFrame, parts: int) -> DataFrame:
    """The candidates once for every part of the anchors."""
    return points.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))


def _first(rows: DataFrame, keys: list[str], score: str, own_id: str, take: int) -> DataFrame:
    order = W.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(own_id))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= take)


def candidates(rows: DataFrame, take: int) -> DataFrame:
    """label, vec, key, ids: equal rows of a label as one, with their first `take` + 1 ids."""
    order = W.partitionBy("label", "vec").orderBy("id")
    return (
        rows.withColumn("n", F.row_number().over(order))
        .where(F.col("n") <= take + 1)
        .groupBy("label", "vec")
        .agg(F.array_sort(F.collect_list("id")).alias("ids"))
        .withColumn("key", F.xxhash64("label", "vec"))
    )


def positives(
    points: DataFrame, anchors: DataFrame, block: int, parts: int, take: int
) -> DataFrame:
    """anchor, key, positive_id, positive_score, rank: the first of the anchor's own label."""
    hot = hot_keys(
        points.groupBy("label").agg(F.count("*").alias("n")), ["label"], "n", block, SHARES
    )
    dealt = _in_parts(add_split(points, hot, ["label"], "key"), parts).select(
        "label", "split", "part", "vec", "ids"
    )
    asked = copy_per_split(anchors, hot, ["label"])
    keys = ["label", "split", "part"]
    found = (
        dealt.groupBy(*keys)
        .cogroup(asked.groupBy(*keys))
        .applyInArrow(
            _positives_of(take), "anchor long, key long, positive_id long, positive_score long"
        )
    )
    return _first(found, ["anchor", "key"], "positive_score", "positive_id", take)


def _pivots(points: DataFrame, block: int, rows: int) -> np.ndarray:
    """Candidates with the least hashes, at most `PIVOTS` of them, as the rows of a matrix."""
    number = min(PIVOTS, math.ceil(rows / block))
    chosen = points.select("key", "vec").orderBy("key").limit(number).collect()
    return matrix(pa.array([r["vec"] for r in chosen], pa.list_(pa.int64())))


def around_pivots(points: DataFrame, pivots: np.ndarray, norm2: float) -> DataFrame:
    """Adds `cell`, the nearest pivot, and `away`, the distance to it, both lifted."""
    shared = send(points.sparkSession, (pivots, norm2))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        centres, most = pickle.loads(shared.value)
        for batch in batches:
            own = matrix(batch.column("vec"))
            width = max(own.shape[1], centres.shape[1])
            high, _ = cover_tree.lifted(matrix(batch.column("vec"), width), most)
            wide = np.zeros((len(centres), width), np.int64)
            wide[:, : centres.shape[1]] = centres
            tops, _ = cover_tree.lifted(wide, most)
            near = high @ tops.T
            cell = near.argmax(1)
            away = np.sqrt(np.maximum(2 * most - 2 * near[np.arange(len(near)), cell], 0))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell, pa.int32()), pa.array(away, pa.float64())],
                [*batch.schema.names, "cell", "away"],
            )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema)
    return points.mapInArrow(assign, f"{kinds}, cell int, away double")


def to_cells(
    asked: DataFrame,
    pivots: np.ndarray,
    radius: dict[int, float],
    norm2: float,
    low: int,
    high: int,
) -> DataFrame:
    """The anchors, once for every cell that may hold a row of one of their windows."""
    cells = np.array(sorted(radius), np.int32)
    tops = cover_tree.CoverTree(
        norm2, pivots[cells].astype(float), np.array([radius[c] for c in cells.tolist()]),
        np.zeros((0, 2), int), np.zeros((0, 2), int), np.zeros(0, int), pivots[:0],
    )
    shared = send(asked.sparkSession, (cells, tops))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        numbers, top = pickle.loads(shared.value)
        for batch in batches:
            queries = matrix(batch.column("vec"))
            width = max(queries.shape[1], top.centres.shape[1])
            queries = matrix(batch.column("vec"), width).astype(float)
            if top.centres.shape[1] < width:
                more = np.zeros((len(numbers), width))
                more[:, : top.centres.shape[1]] = top.centres
                top.centres = more
            rows, to = [], []
            for row, windows in enumerate(batch.column("windows").to_pylist()):
                under, over = top.bounds(
                    queries[row], float(queries[row] @ queries[row]), 0, len(numbers)
                )
                meets = np.zeros(len(numbers), bool)
                for window in windows:
                    least, most = window_of(window["positive_score"], low, high)
                    if least <= most:
                        meets |= (over >= least) & (under <= most)
                to.append(numbers[meets])
                rows.append(np.full(int(meets.sum()), row))
            taken = batch.take(pa.array(np.concatenate(rows) if rows else [], pa.int64()))
            cell = pa.array(np.concatenate(to) if to else [], pa.int32())
            yield pa.RecordBatch.from_arrays([*taken.columns, cell], [*batch.schema.names, "cell"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema)
    return asked.mapInArrow(route, f"{kinds}, cell int")


def mine(
    rows: DataFrame,
    anchor: Column,
    n_positives: int = 5,
    n_negatives: int = 5,
    low: int = 80,
    high: int = 100,
) -> DataFrame:
    """Hard negatives of the rows that `anchor` marks, among all `rows` (id, label, vec).

    anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for an anchor and
    each of its first `n_positives` rows of its label, the first `n_negatives` rows of other
    labels whose score is between `low` and `high` hundredths of the positive's.
    """
    rows = kept(
        rows.where("id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL")
        .select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "vec")
        .distinct()
    )
    # Columns of their own: both sides of a grouping may not share theirs.
    asked = rows.where(anchor).select(
        F.col("id").alias("anchor"),
        F.col("label").alias("label"),
        F.col("vec").alias("vec"),
        F.xxhash64("label", "vec").alias("key"),
    )
    points = kept(candidates(rows, max(n_positives, n_negatives)))
    size2 = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    figures = points.agg(F.count("*").alias("n"), F.max(size2).alias("norm2")).first()
    n, norm2 = figures["n"], figures["norm2"] or 0.0
    block = int(min(MOST_BLOCK, max(LEAST_BLOCK, 8 * math.sqrt(n))))
    parts = max(1, math.ceil(asked.count() / PART))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("anchor"), F.lit(parts)).cast("int"))

    best = positives(points, asked, block, parts, n_positives)
    # At most `n_positives` of them an anchor.
    scores = F.collect_list(F.struct("positive_id", "positive_score"))
    windows = best.groupBy("anchor", "key").agg(scores.alias("windows"))
    asked = kept(asked.join(windows, ["anchor", "key"]))

    pivots = _pivots(points, block, n)
    placed = kept(around_pivots(points, pivots, norm2))
    cells = kept(
        placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"))
    )
    radius = {r["cell"]: r["radius"] for r in cells.collect()}
    hot = hot_keys(cells, ["cell"], "n", block, SHARES)
    dealt = _in_parts(add_split(placed, hot, ["cell"], "key"), parts).select(
        "cell", "split", "part", "label", "vec", "ids"
    )
    routed = copy_per_split(to_cells(asked, pivots, radius, norm2, low, high), hot, ["cell"])
    keys = ["cell", "split", "part"]
    found = (
        dealt.groupBy(*keys)
        .cogroup(routed.groupBy(*keys))
        .applyInArrow(
            _negatives_of(n_negatives, low, high),
            "anchor long, key long, positive_id long, positive_score long,"
            " negative_id long, negative_score long",
        )
    )
    return _first(
        found, ["anchor", "key", "positive_id"], "negative_score", "negative_id", n_negatives
    ).select(
        F.col("anchor").alias("anchor_id"),
        "positive_id",
        "rank",
        "negative_id",
        "positive_score",
        "negative_score",
    )
