"""The prefix trie against a plain trie in Python, and its query against SQL on odd rows."""

import hashlib
import random
import zlib

import duckdb
import pytest

from musterline.llm import oracles, prefix_trie
from musterline.llm.queries import op13_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = (
    "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
)


def plain(rows):
    """The trie by dictionaries of whole prefixes."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    members, ends = {}, {}
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        whole = tuple(own.get(base, [])[:h] + own[c][h:])
        ends.setdefault(whole, []).append(c)
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], []).append(c)
    children = {}
    for node in members:
        if node:
            children[node[:-1]] = children.get(node[:-1], 0) + 1
    leaves, saved = {}, {}
    for node, convs in members.items():
        gain = (len(convs) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] = leaves.get(node[:d], 0) + (node not in children)
            saved[node[:d]] = saved.get(node[:d], 0) + gain
    return sorted(
        (
            min(convs), len(node), min(members[node[:-1]]) if node else -1, len(convs),
            children.get(node, 0), leaves[node], saved[node],
            hashlib.sha256(",".join(map(str, ends.get(node, []))).encode()).hexdigest(),
        )
        for node, convs in members.items()
    )


def found(frame):
    return sorted(
        tuple(-1 if r[n] is None else r[n] for n in NAMES) for r in frame.collect()
    )


def odd_rows():
    rng = random.Random(3)
    rows = [(None, 1, "user", "lost"), (None, None, None, None)]
    for c in list(range(0, 90)) + [-1, -5, -7, 1003]:
        if c % 10 == 5:
            continue
        for turn in range(rng.randint(1, 12)):
            rows.append((c, turn, rng.choice(["user", None, "é"]), rng.choice(["a", "b", None, "", "ü ü"])))
    rows += [(11, None, "user", "first"), (12, 3, "user", "tie a"), (12, 3, "user", "tie b"), (12, 3, "a", "z")]
    rows += [(13, 1, "user", "twice"), (13, 1, "user", "twice")]
    # One very long conversation, whose opening others share, and one of very long texts.
    rows += [(40, t, "user", f"turn {t % 7}") for t in range(150)]
    rows += [(50, 0, "user", "long " * 40_000)]
    # Many conversations that are equal.
    rows += [(c, t, "user", f"same {t}") for c in range(6000, 6400) for t in range(4)]
    return rows


@pytest.mark.parametrize("height", [2, 7, 16])
def test_trie_equals_a_plain_one(spark, monkeypatch, height):
    monkeypatch.setattr(prefix_trie, "BLOCK", 32)
    rows = odd_rows()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = prefix_trie.trie(prefix_trie.shared_openings(frame), height)
    assert found(got) == plain(rows)


def test_children_of_hot_parents_are_split(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "MANY_CHILDREN", 3)
    rows = odd_rows()
    got = prefix_trie.trie(prefix_trie.shared_openings(spark.createDataFrame(rows, SCHEMA)))
    assert found(got) == plain(rows)


def test_query_equals_sql_on_odd_rows_and_clashing_names(spark, tmp_path):
    rows = [r for r in odd_rows() if r[0] != 40]
    extra = [(*r, 7, "x", 1, 2) for r in rows]
    schema = SCHEMA + ", conv long, `a.b` string, ka long, depth long"
    frame = spark.createDataFrame(extra, schema)
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    connection = duckdb.connect()
    connection.execute(
        f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')"
    )
    cursor = connection.execute(oracles.PREFIX_TRIE)
    names = [c[0] for c in cursor.description]
    theirs = sorted(
        tuple(-1 if row[names.index(n)] is None else row[names.index(n)] for n in NAMES)
        for row in cursor.fetchall()
    )
    assert found(op13_prefix_trie(spark, str(tmp_path))) == theirs


def test_conversation_without_turns_of_its_own_is_a_member_of_the_root(spark):
    # 4's opening comes from conversation 0, which is absent, and its only turn is replaced.
    alone = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 1)
    rows = [(alone, 0, "user", "gone")]
    got = found(prefix_trie.trie(prefix_trie.shared_openings(spark.createDataFrame(rows, SCHEMA))))
    assert got == plain(rows) and len(got) == 1 and got[0][1] == 0
    assert got[0][-1] == hashlib.sha256(str(alone).encode()).hexdigest()


def test_empty_table(spark):
    assert found(prefix_trie.trie(prefix_trie.shared_openings(spark.createDataFrame([], SCHEMA)))) == []
