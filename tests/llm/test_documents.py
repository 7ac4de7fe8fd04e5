"""Operators over documents against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from musterline.llm import common, decontaminate, mixing, oracles, rules, sharding, simhash, token_counts

LETTERS = "abcdefghij"


def texts(seed, n, words=60, vocabulary=40):
    rng = random.Random(seed)
    names = ["".join(rng.choices(LETTERS, k=rng.randint(1, 6))) for _ in range(vocabulary)]
    return [
        " ".join(rng.choice(names) for _ in range(rng.randint(0, words))) for _ in range(n)
    ]


# SimHash


def plain_fingerprint(text, k):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or (
        [" ".join(words)] if words else []
    )
    values = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def plain_components(numbers, radius):
    parent = {n: n for n in numbers}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    order = sorted(numbers)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                parent[root(b)] = root(a)
    return {n: root(n) for n in numbers}


def test_near_duplicates_equal_brute_force(docs_of, odd_rows):
    rng = random.Random(9)
    rows = [(100 + i, t) for i, t in enumerate(texts(1, 60, 30))]
    for i, (_, text) in enumerate(list(rows)):
        words = text.split()
        if words:
            words[rng.randrange(len(words))] = "changed"
        rows.append((300 + i, " ".join(words)))
    rows += odd_rows
    got = simhash.near_duplicates(docs_of(rows)).collect()
    prints = [(i, plain_fingerprint(t, 4)) for i, t in rows]
    roots = plain_components({f for _, f in prints}, 4)
    least = defaultdict(list)
    for i, f in prints:
        if i is not None:
            least[roots[f]].append(i)
    want = [(i, f"{f:016x}", min(least[roots[f]], default=None)) for i, f in prints]
    assert Counter(map(tuple, got)) == Counter(want)


def test_all_links_within_the_radius_connect(spark):
    rng = random.Random(4)
    numbers = {rng.getrandbits(64) for _ in range(300)}
    for n in list(numbers)[:120]:
        for _ in range(3):
            numbers.add(n ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    signed = [n - (1 << 64) if n >> 63 else n for n in numbers]
    frame = spark.createDataFrame([(n,) for n in signed], "fingerprint long")
    links = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links_of(frame, 4).collect()]
    got = plain_components(numbers, 4)
    parent = {n: n for n in numbers}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        parent[root(max(a, b))] = root(min(a, b))
    groups = lambda of: sorted(sorted(n for n in numbers if of(n) == r) for r in set(map(of, numbers)))
    assert groups(root) == groups(got.get)


def test_a_crowded_value_is_worked_off_in_parts(monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, 40, dtype=np.int64)
    numbers = np.concatenate([base, base ^ (1 << 50), base ^ 0b1011])
    whole = simhash.link_one_value(0, numbers & ~0xFF00, 0xFF00, 2)
    monkeypatch.setattr(simhash, "MOST_VARIANTS", 3000)
    parts = simhash.link_one_value(0, numbers & ~0xFF00, 0xFF00, 2)
    assert len(whole) and sorted(map(tuple, whole)) == sorted(map(tuple, parts))
    # Several tasks, each with all fingerprints and a part of the variants.
    split = np.concatenate([simhash.link_one_value(0, numbers & ~0xFF00, 0xFF00, 2, i, 4) for i in range(4)])
    wanted = {(int(a) % (1 << 64), int(b) % (1 << 64)) for a, b in whole}
    groups = plain_groups({(int(a) % (1 << 64), int(b) % (1 << 64)) for a, b in split})
    assert groups == plain_groups(wanted)


def plain_groups(links):
    parent = {n: n for link in links for n in link}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    found = defaultdict(set)
    for n in parent:
        found[root(n)].add(n)
    return sorted(map(sorted, found.values()))


def test_many_near_fingerprints_stay_within_memory():
    import tracemalloc

    rng = np.random.default_rng(6)
    numbers = np.unique([sum(1 << int(b) for b in rng.choice(40, 3)) for _ in range(8000)]).astype(np.int64)
    tracemalloc.start()
    links = simhash.link_one_value(0, numbers, 0b11 << 60, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20 and len(plain_groups({tuple(map(int, link)) for link in links})) == 1


def test_crowded_values_large_groups_and_common_fingerprints_are_split(spark, docs_of, monkeypatch):
    monkeypatch.setattr(simhash, "CROWDED", 5000)
    monkeypatch.setattr(simhash, "SPLIT_ROWS", 3)
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(i, base + f" end{i % 25}") for i in range(60)] + [(100 + i, "") for i in range(20)]
    rows += [(200 + i, t) for i, t in enumerate(texts(21, 30, 30))]
    got = simhash.near_duplicates(docs_of(rows)).collect()
    prints = {i: plain_fingerprint(t, 4) for i, t in rows}
    roots = plain_components(set(prints.values()), 4)
    least = defaultdict(list)
    for i, f in prints.items():
        least[roots[f]].append(i)
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: min(least[roots[f]]) for i, f in prints.items()}
    assert len(got) == len(rows)


def test_one_document_of_each_group_stays(docs_of, odd_rows):
    docs = docs_of(odd_rows).withColumnRenamed("lang", "fingerprint")
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    # Blank texts are one group, so are the equal ones; the smallest id stays.
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 4, 6, 7])


# Decontamination


def plain_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_contamination(rows, items, window=10):
    out = []
    for doc_id, text in rows:
        words, hit, found = plain_words(text), set(), set()
        for item_id, content in items:
            own = plain_words(content)
            n = min(window, len(own))
            for s in range(len(own) - n + 1 if n else 0):
                for at in range(len(words) - n + 1):
                    if words[at : at + n] == own[s : s + n]:
                        hit.update(range(at, at + n))
                        found.add(item_id)
        ids = sorted(str(i) for i in found if i is not None)
        out.append((doc_id, len(words), len(hit), tuple(ids)))
    return out


def test_contamination_equals_brute_force(spark, docs_of, odd_rows):
    rows = [(100 + i, t) for i, t in enumerate(texts(5, 80, 70, 12))]
    items = [(i, t) for i, t in enumerate(texts(6, 12, 30, 12))]
    items += [(50, "two three"), (51, "Gamma"), (52, None), (53, ""), (None, "delta alpha"), (0, items[0][1])]
    for i, (_, text) in enumerate(items[:8]):
        rows.append((200 + i, "Before: " + (text or "").upper() + "; after"))
    rows += odd_rows
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs_of(rows), bench).collect()
    want = plain_contamination([(r[0], r[1]) for r in rows], items)
    assert sum(w[2] > 0 for w in want) > 10
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got) == Counter(want)
    clean = decontaminate.clean(docs_of(rows).withColumnRenamed("lang", "window"), bench)
    assert clean.columns[2] == "window"
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(w[0] for w in want if not w[2])


# Mixing


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    total = sum(sizes.values())
    while True:
        rest = total - sum(target.values())
        share = sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] / share > most * sizes[s]} if share else set()
        if not over:
            return target | {s: rest * weight[s] / share for s in open_}
        for s in over:
            target[s] = most * sizes[s]
        open_ -= over


def test_mix_meets_its_targets(spark, docs_of, odd_rows):
    rng = random.Random(8)
    rows = [(100 + i, t, rng.choice(["a", "b", "B", "é", None, "rare"][: 5 if i % 40 else 6]))
            for i, t in enumerate(texts(7, 200, 50))]
    rows += [(i, t, "a") for i, t in odd_rows] + [rows[3]] * 5
    docs = docs_of(rows)
    planned = mixing.plan(docs).collect()
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = plain_targets(sizes)
    got = Counter()
    for r in planned:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["within"] <= r["size"] * r["copies"]
        got[r["source"]] += r["epochs"] * r["size"] * r["copies"] + r["within"]
    for source, target in want.items():
        assert got[source] == math.floor(round(target, 6))
    taken = mixing.taken(mixing.plan(docs)).collect()
    assert Counter(r["doc_id"] for r in taken) == Counter(r[0] for r in rows)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in taken)
    assert sum(r["taken"] for r in taken) == sum(got.values())
    assert sorted(map(str, planned)) == sorted(map(str, mixing.plan(docs.repartition(7)).collect()))


@pytest.mark.parametrize("most_bytes", [mixing.BROADCAST_BYTES, -1])
def test_mixed_rows_hold_what_the_plan_takes(docs_of, monkeypatch, most_bytes):
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", most_bytes)
    rows = [(i, f"w{i} " * (i % 7 + 1), f"s{i % 4}" if i % 9 else "rare") for i in range(80)]
    rows += [(90, "", "s1"), (91, None, "s1"), (92, "x y", None), (93, "", "blank")]
    rows += [(None, f"n{i} " * 3, None) for i in range(30)] + [(94, "a b c", "s2")] * 4
    docs = docs_of(rows).withColumnRenamed("lang", "size")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    planned = Counter()
    for r in mixing.plan(docs).collect():
        planned[r["doc_id"]] += r["epochs"] * r["size"] * r["copies"] + r["within"]
    words = Counter()
    for r in out.collect():
        words[r["doc_id"]] += len((r["text"] or "").split())
    assert {i: words[i] for i in planned} == dict(planned)


@pytest.mark.parametrize("at_once", [4096, 7])
def test_a_budget_that_ends_in_copies_is_met_to_the_word(spark, docs_of, monkeypatch, at_once):
    monkeypatch.setattr(common, "COPIES_AT_ONCE", at_once)
    # One row of 10 words 50 times; its source's target of 359 words is no multiple of anything.
    rows = [(1, "ten words " * 5, "a")] * 50 + [(10 + i, f"w{i}", "b") for i in range(218)]
    docs = docs_of(rows)
    (target,) = {r["target"] for r in mixing.plan(docs).collect() if r["source"] == "a"}
    whole, rest = divmod(math.floor(target), 10)
    taken = sorted(r["taken"] for r in mixing.taken(mixing.plan(docs)).collect() if r["doc_id"] == 1)
    assert taken == sorted([10] * whole + [rest] * (rest > 0) + [0] * (50 - whole - (rest > 0)))
    lengths = sorted(len(r["text"].split()) for r in mixing.mixed(docs).where("doc_id = 1").collect())
    assert lengths == sorted([10] * whole + [rest] * (rest > 0)) and 0 < whole < 50
    # The same by the SQL of the query.
    connection = duckdb.connect()
    connection.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    connection.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    cursor = connection.execute(oracles.MIXING)
    names = [c[0] for c in cursor.description]
    theirs = sorted((r[names.index("doc_id")], r[names.index("taken")]) for r in cursor.fetchall())
    mine = sorted((r["doc_id"], r["taken"]) for r in mixing.taken(mixing.plan(docs)).collect())
    assert mine == theirs


def test_mixing_an_empty_table(docs_of):
    assert mixing.mixed(docs_of([])).count() == 0


def test_shortened_texts_keep_their_white_space(spark):
    frame = spark.createDataFrame([(" a\tb\n\nc d ", 3)], "t string, n int")
    assert frame.select(mixing.first_words(frame.t, frame.n)).first()[0] == " a\tb\n\nc"


# Sharding


def test_shards_hold_their_law(docs_of, odd_rows):
    rows = [(100 + i, t) for i, t in enumerate(texts(11, 300))] + odd_rows + [(9, "same")] * 50
    docs = docs_of(rows)
    got = sharding.place(docs, shards=5, bucket_bytes=2000).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    slots = defaultdict(list)
    shard_of, grown_of = {}, {}
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert 0 <= r["shard"] < 5 and r["grown_shard"] in (r["shard"], 5)
        assert shard_of.setdefault(r["doc_id"], r["shard"]) == r["shard"]
        grown_of[r["doc_id"]] = r["grown_shard"]
    for own in slots.values():
        assert sorted(own) == list(range(len(own)))
    six = {r["doc_id"]: r["shard"] for r in sharding.place(docs, shards=6).collect()}
    assert six == grown_of and 5 in six.values()
    content = Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got)
    assert content == Counter(
        (i, 16 + len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t in rows
    )
    again = sharding.place(docs.repartition(3), shards=5, bucket_bytes=2000).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    # Copies of a row spread over the shard's buckets.
    assert len({r["bucket"] for r in got if r["doc_id"] == 9}) > 1


def test_slots_do_not_follow_ids(docs_of):
    got = sharding.place(docs_of([(i, "x") for i in range(400)]), shards=1).collect()
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["slot"])]
    assert order != sorted(order) and abs(np.corrcoef(order, range(400))[0, 1]) < 0.2


def test_sharded_rows_are_the_rows(docs_of, odd_rows):
    docs = docs_of(odd_rows * 2)
    out = sharding.sharded(docs, shards=3)
    assert Counter(map(tuple, out.select(*docs.columns).collect())) == Counter(map(tuple, docs.collect()))
    assert len(set(map(tuple, out.select("shard", "slot").collect()))) == 2 * len(odd_rows)
    named = sharding.sharded(docs.withColumnsRenamed({"lang": "slot", "source": "SHARD"}))
    assert named.columns == ["doc_id", "text", "slot_input", "SHARD_input", "n_chars", "shard", "slot"]
    assert Counter(tuple(r)[:5] for r in named.collect()) == Counter(map(tuple, docs.collect()))


def test_a_hot_id_gets_more_buckets(docs_of):
    rows = [(None, f"{i:0100d}") for i in range(300)] + [(i, "x" * 100) for i in range(300)]
    rows += [(None, "y" * 100)] * 300
    sizes = defaultdict(Counter)
    for r in sharding.place(docs_of(rows), shards=5, bucket_bytes=2000).collect():
        sizes[r["shard"]][r["bucket"]] += r["size"]
    assert max(len(own) for own in sizes.values()) > 30
    assert all(sum(own.values()) / len(own) <= 2200 for own in sizes.values())


# Quality rules


def plain_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = defaultdict(list)
    for i in range(len(words) - 4):
        runs[tuple(words[i : i + 5])].append(i)
    again = {p for at in runs.values() if len(at) > 1 for i in at for p in range(i, i + 5)}
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (
        len(words),
        sum(map(len, words)),
        sum((text or "").count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)),
        len(again),
        len(words) < 10 or 100 * len(again) > 20 * len(words),
    )


def test_base_figures_equal_brute_force(docs_of, odd_rows):
    rows = odd_rows + [(100 + i, t) for i, t in enumerate(texts(13, 100, 60, 3))]
    rows += [(300, "a b\na b\n\n a b\n#x|<"), (301, "a b c d e " * 2), (302, "ä €\x0b|" * 30)]
    got = rules.judge(docs_of(rows)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter((r["doc_id"], *(r[n] for n in names)) for r in got) == Counter(
        (i, *plain_rules(t)) for i, t in rows
    )
    assert all(not r["kept"] for r in got if r["base_failed"])


PROSE = "The river ran past the mill and the old men watched it go by."


@pytest.mark.parametrize(
    "line, stays",
    [
        (PROSE, True),
        ("“Was it?”", True),
        ("Home | News | Sport | Contact |", False),
        ("BUY!! NOW!! CHEAP!!", False),
        ("odd%%% junk### here***.", False),
        ("All rights reserved.", False),
        ("no end mark here", False),
        ("It breaks off. But it is prose", True),
    ],
)
def test_lines(docs_of, line, stays):
    more = "Later that year a letter came, and nobody in the house could say who had sent it."
    text = "\n".join([PROSE if line != PROSE else "He left.", line, more])
    cleaned = rules.clean(docs_of([(1, text)])).first()["text"]
    assert (line in cleaned.split("\n")) == stays


def test_documents_losing_most_words_go(docs_of):
    bars = " | ".join(f"item{i}" for i in range(60))
    docs = docs_of([(1, PROSE + "\n" + bars), (2, PROSE + "\nAll rights reserved.")])
    assert [r["doc_id"] for r in rules.clean(docs).collect()] == [2]


def test_long_lines_are_judged_for_boilerplate(docs_of):
    terms = "By use of the site you accept our terms of service and our privacy policy. " * 5
    prose = "She had read the terms of service twice, and then the rain came over the hills. "
    prose += "Nobody on the road that day could remember a harder storm, or a longer one. " * 3
    rows = [(1, f"{prose}\n{terms.strip()}"), (2, f"{prose}\nAll rights reserved.")]
    assert len(terms) > 300 and len(prose) > 300
    got = {r["doc_id"]: r["lines_removed"] for r in rules.judge(docs_of(rows)).collect()}
    assert got == {1: 1, 2: 1}
    assert docs_of(rows).select(rules.line_fails(F.lit(prose)), rules.line_fails(F.lit(terms))).first()[:] == (
        False,
        True,
    )


@pytest.mark.parametrize("end", ["\r", "\t", " \x0b", "\x0c \r"])
def test_white_space_at_line_ends_hides_no_end_mark(docs_of, end):
    lines = [PROSE, "Later that year a letter came for him.", "Nobody could say who had sent it."]
    rows = [(1, "\n".join(x + end for x in lines)), (2, "\n".join(lines))]
    got = {r["doc_id"]: (r["kept"], r["lines_removed"]) for r in rules.judge(docs_of(rows)).collect()}
    assert got == {1: (True, 0), 2: (True, 0)}


# Token counts


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(token_counts.ranks())


def test_edited_counts_equal_a_fresh_count(counter, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK", 4)
    rng = random.Random(21)
    parts = ["word", " ", "  ", "\n\n", "it's", "'ll", "42", "…!", "é", "\t", "日本", "'", " x", "don't we"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        tree = token_counts.Tree(text, counter)
        for _ in range(3):
            a = rng.randint(0, len(text))
            b = rng.randint(a, min(len(text), a + 9))
            new = "".join(rng.choice(parts) for _ in range(rng.randint(0, 4)))
            tree.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert tree.text() == text
            assert [p for ps, _ in tree.leaves for p in ps] == counter.cut(text)
            assert tree.tokens[1] == len(counter.encoding.encode_ordinary(text))
            assert tree.chars[1] == len(text)


def test_only_the_region_of_an_edit_is_encoded_anew(counter):
    tree = token_counts.Tree("some words and more of them. " * 2000, counter)
    tree.edit(30_000, 30_004, "other")
    assert tree.reencoded < 20


def test_counts_of_odd_rows(docs_of, odd_rows, counter):
    docs = docs_of(odd_rows)
    edits = token_counts.spread_edits(docs["text"])
    got = token_counts.counts(docs, edits, ["doc_id"], token_counts.ranks()).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == Counter(
        (i, len(counter.encoding.encode_ordinary(t or ""))) for i, t in odd_rows
    )
    with pytest.raises(ValueError):
        token_counts.count_one("abc", [{"start": 2, "end": 9, "text": ""}], counter)


# Rules against their SQL, on rows that the given tables lack


def test_rules_equal_their_sql_on_odd_lines(docs_of, odd_rows):
    long = "this paragraph is released under the terms and it goes on " * 9
    rows = [
        (1, "A sentence ends here.\r\nAnother one ends too!\r\n"),
        (2, "tabs behind the mark.\t\nand none\t\n no mark at all \x0b\nblanks.   "),
        (3, long),
        (4, long + " all rights reserved. powered by us. privacy policy."),
        (5, "Home | About | Contact | Imprint | Search\nhome sweet home is where the heart is and was.\n" * 3),
        (6, "menu\n\n\nPrices: $5 & $6 * #7 |\n!!! !!! so loud !! it is !!"),
        (7, "x " * 30 + "\n" + "y. " * 30),
    ]
    docs = docs_of(rows + odd_rows)
    connection = duckdb.connect()
    connection.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    connection.executemany("INSERT INTO documents VALUES (?, ?)", [(r[0], r[1]) for r in rows + odd_rows])
    cursor = connection.execute(oracles.RULES)
    names = [c[0] for c in cursor.description]
    mine = rules.judge(docs).select(*names).collect()
    assert sorted(map(repr, map(tuple, mine))) == sorted(map(repr, cursor.fetchall()))


def test_the_bitmap_grows_with_the_benchmark(spark, docs_of, odd_rows, monkeypatch):
    few = spark.range(1000).select(F.xxhash64("id").alias("hash"))
    many = spark.range(200_000).select(F.xxhash64("id").alias("hash"))
    assert decontaminate.cells_for(few) == decontaminate.LEAST_CELLS
    assert decontaminate.cells_for(many) == 17
    other = spark.range(300_000, 320_000).select(F.xxhash64("id").alias("hash"))
    cells = decontaminate.bitmap(many, 17)
    passed = other.where(decontaminate.in_bitmap(cells, F.col("hash"), 17)).count()
    assert passed < 20_000 / 20 and many.where(~decontaminate.in_bitmap(cells, F.col("hash"), 17)).count() == 0
    # Any size gives the same result.
    rows = [(100 + i, t) for i, t in enumerate(texts(31, 80, 40, 12))]
    parts = [(i, " ".join(t.split()[3:18])) for i, (_, t) in enumerate(rows[:40])]
    items = spark.createDataFrame(parts, "item_id long, text string")
    look = lambda: sorted(map(str, decontaminate.contamination(docs_of(rows + odd_rows), items).collect()))
    whole = look()
    monkeypatch.setattr(decontaminate, "LEAST_CELLS", 0)
    monkeypatch.setattr(decontaminate, "BITS_EACH", 1)
    assert look() == whole and any("n_hit=0" not in row for row in whole)
