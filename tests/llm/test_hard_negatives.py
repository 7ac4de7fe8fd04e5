"""Cover trees and hard negatives against comparing all rows with all anchors."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from musterline.llm import cover_tree, hard_negatives, oracles
from musterline.llm.queries import op12_hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def test_tree_covers_and_search_equals_sorting():
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 60, (12, 6))
    points = np.floor(centres[rng.integers(0, 12, 3000)] + rng.normal(0, 9, (3000, 6))).astype(np.int64)
    points[100:400] = points[7]
    tree = cover_tree.build(points, 400)
    assert sorted(tree.order.tolist()) == list(range(3000))
    high, norm2 = cover_tree.lifted(points)
    tops, _ = cover_tree.lifted(tree.centres, norm2)
    for node, (start, stop) in enumerate(tree.span):
        away = cover_tree.distances(high[tree.order[start:stop]], norm2, tops[node])
        assert away.max() <= tree.radius[node] + 1e-3 * math.sqrt(norm2)
    allowed = rng.random(3000) < 0.7
    ids = [[i] for i in range(3000)]
    for _ in range(25):
        query = np.floor(rng.normal(0, 60, 6)).astype(np.int64)
        scores = points @ query
        most = int(np.quantile(scores, 0.9))
        windows = [(-math.inf, math.inf), (most // 2, most), (most, most + 50), (10**9, 10**10)]
        got = cover_tree.search(tree, query, allowed, ids, 11, windows, 5)
        for (low, top), best in zip(windows, got):
            good = [
                (-int(s), i) for i, s in enumerate(scores) if allowed[i] and low <= s <= top and i != 11
            ]
            assert [(-s, i) for s, i in best] == sorted(good)[:5]


def test_very_large_components_stay_exact():
    points = np.array([[1 << 62, 1], [1 << 62, 2], [-(1 << 62), 5]], np.int64)
    tree = cover_tree.build(points, 1 << 62)
    got = cover_tree.search(
        tree, np.array([1 << 62, 1]), np.ones(3, bool), [[0], [1], [2]], None, [(-math.inf, math.inf)], 3
    )
    assert [i for _, i in got[0]] == [1, 0, 2] and got[0][0][0] == (1 << 124) + 2


def odd_rows():
    rng = np.random.default_rng(8)
    rows = [
        (i, [float(x) for x in rng.normal(0, 1, 5)], int(rng.integers(0, 4))) for i in range(700)
    ]
    # Many copies of one vector, anchors among them, over two labels; repeated rows; ties.
    rows += [(i, [0.5, 0.5, 0.5, 0.25, 1.0], i % 2) for i in range(1000, 1600)]
    rows += rows[:40] + [rows[100]] * 3
    rows += [(2000, None, 1), (2001, [], 2), (2002, [1.0, None, 0.0, 0.0, 0.0], 1), (2100, [float("nan")] * 5, 1)]
    rows += [(2003, [float("inf")] * 5, 1), (2200, [0.25] * 5, None), (None, [9.0] * 5, 1), (2300, [0.0] * 5, 1)]
    rows += [(2004, [1.0, 1.0], 3), (2400, [1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0], 0), (-100, [0.3] * 5, 2), (2500, [-1.0] * 5, 9)]
    # One id with two vectors.
    rows += [(2600, [0.1, 0.2, 0.3, 0.4, 0.5], 1), (2600, [0.5, 0.4, 0.3, 0.2, 0.1], 1)]
    return rows


def expected(folder):
    connection = duckdb.connect()
    connection.execute(
        f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet/*.parquet')"
    )
    cursor = connection.execute(oracles.HARD_NEGATIVES)
    names = [c[0] for c in cursor.description]
    return names, sorted(cursor.fetchall())


@pytest.mark.parametrize("block, part", [(1024, 16_384), (60, 4)])
def test_query_equals_sql_on_odd_rows(spark, tmp_path, monkeypatch, block, part):
    monkeypatch.setattr(hard_negatives, "LEAST_BLOCK", block)
    monkeypatch.setattr(hard_negatives, "MOST_BLOCK", block)
    monkeypatch.setattr(hard_negatives, "PART", part)
    monkeypatch.setattr(cover_tree, "LEAF", 16)
    rows = [(*r, 1, 2, 3.0) for r in odd_rows()]
    frame = spark.createDataFrame(rows, SCHEMA + ", cell int, `a.b` int, key double")
    frame.repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    names, theirs = expected(tmp_path)
    mine = op12_hard_negatives(spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(tuple, mine)) == theirs and len(theirs) > 50


def test_empty_table(spark):
    rows = spark.createDataFrame([], "id long, label long, vec array<long>")
    assert hard_negatives.mine(rows, F.col("id") % 100 == 0).collect() == []
