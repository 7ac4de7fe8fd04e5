"""TF-IDF and topics against plain numpy, and both with every term split."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from musterline.functions import special
from musterline.operators import skew, term_blocks, terms, topics

TEXTS = {
    1: "alpha beta gamma alpha delta",
    2: "alpha beta beta epsilon zeta",
    3: "gamma delta alpha eta theta gamma",
    4: "zeta epsilon beta alpha beta",
    5: "delta gamma eta alpha gamma delta",
    6: "alpha zeta beta epsilon issue beta",
    7: "alpha",
    8: "omega",
    9: "gamma delta eta theta gamma alpha",
    10: "epsilon zeta zeta beta alpha",
}


def docs(spark):
    return spark.createDataFrame(
        [("all", k, t.split()) for k, t in TEXTS.items()], "corpus string, k int, tokens array<string>"
    )


def expected_weights():
    counts = {}
    for key, text in TEXTS.items():
        tokens = [t for t in text.split() if t != "issue"]
        counts[key] = Counter(tokens + [f"{a} {b}" for a, b in zip(tokens, tokens[1:])])
    frequency = Counter(term for c in counts.values() for term in c)
    n = len(TEXTS)
    idf = {
        t: math.log((1 + n) / (1 + df)) + 1 for t, df in frequency.items() if 2 <= df <= 0.9 * n
    }
    result = {}
    for key, c in counts.items():
        raw = {t: tf * idf[t] for t, tf in c.items() if t in idf}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        result.update({(key, t): v / norm for t, v in raw.items()})
    return result


@pytest.fixture(params=[terms.SPLIT_ROWS, 1], ids=["whole", "split"])
def table(request, spark, monkeypatch):
    monkeypatch.setattr(terms, "SPLIT_ROWS", request.param)
    found = terms.tfidf_by_split(docs(spark), "k", ("all",))
    if request.param == 1:
        assert found.where("splits > 1").count() > 0
    return found


def test_tfidf_against_the_formula(table):
    found = {(r.k, r.term): r.weight for r in table.collect()}
    expected = expected_weights()
    assert set(found) == set(expected)
    assert all(found[at] == pytest.approx(expected[at], abs=1e-12) for at in expected)
    assert "issue" not in {t for _, t in found}


def test_corpora_are_counted_apart(spark):
    both = docs(spark).unionByName(
        docs(spark).where("k <= 5").select(F.lit("more").alias("corpus"), F.expr("k + 100").alias("k"), "tokens")
    )
    together = terms.tfidf(both, "k", ("all", "more"))
    alone = terms.tfidf(docs(spark), "k", ("all",))
    pick = lambda f: sorted((r.k, r.term, round(r.weight, 12)) for r in f.where("corpus = 'all'").collect())
    assert pick(together) == pick(alone)


def plain_model(weights, start, passes):
    """Batch variational model over dictionaries; `start` is term -> topic weights."""
    k = len(next(iter(start.values())))
    prior, lam = 1.0 / k, {t: np.array(v, float) for t, v in start.items()}
    by_doc = {}
    for (key, term), w in weights.items():
        by_doc.setdefault(key, []).append((term, w))

    def factors():
        whole = special.digamma(sum(lam.values()))
        return {t: np.exp(special.digamma(v) - whole) for t, v in lam.items()}

    def mixture(items, beta):
        gamma = np.ones(k)
        for _ in range(topics.MIXTURE_STEPS):
            theta = np.exp(special.digamma(gamma) - special.digamma(gamma.sum()))
            fresh = prior + theta * sum(w / (theta @ beta[t]) * beta[t] for t, w in items)
            moved, gamma = np.abs(fresh - gamma).mean(), fresh
            if moved < topics.MIXTURE_TOLERANCE:
                break
        return gamma

    for _ in range(passes):
        beta, gained = factors(), {t: np.zeros(k) for t in lam}
        for items in by_doc.values():
            gamma = mixture(items, beta)
            theta = np.exp(special.digamma(gamma) - special.digamma(gamma.sum()))
            for t, w in items:
                gained[t] += w * theta * beta[t] / (theta @ beta[t])
        lam = {t: prior + g for t, g in gained.items()}
    beta = factors()
    gammas = {key: mixture(items, beta) for key, items in by_doc.items()}
    return lam, {key: g / g.sum() for key, g in gammas.items()}


def test_topics_against_plain_numpy(spark, table):
    names = [f"topic_{i}" for i in range(4)]
    start = table.select("corpus", "term").distinct().select(
        "term", *[topics._start(i, topics.SEED).alias(n) for i, n in enumerate(names)]
    )
    start = {r.term: [r[n] for n in names] for r in start.collect()}
    lam, mixtures = plain_model(expected_weights(), start, topics.PASSES)
    found_terms, found_mixtures = topics.fit_topics(table, "k", ("all",))
    for row in found_terms.collect():
        assert [row[n] for n in names] == pytest.approx(lam[row.term].tolist(), rel=1e-6)
    rows = found_mixtures.collect()
    assert {r.k for r in rows} == set(mixtures)
    for row in rows:
        assert row.mixture == pytest.approx(mixtures[row.k].tolist(), rel=1e-5)
        assert sum(row.mixture) == pytest.approx(1.0)
    for row in topics.topic_keywords(found_terms).collect():
        ranked = sorted(lam, key=lambda t: (-round(lam[t][row.topic], 9), t))[:5]
        assert row.keywords == [t.replace(" ", "_") for t in ranked]


def test_chunks_of_documents_change_nothing(spark, table, monkeypatch):
    pick = lambda f: sorted((r.k, *[round(x, 9) for x in r.mixture]) for r in f.collect())
    whole = pick(topics.fit_topics(table, "k", ("all",), passes=1)[1])
    monkeypatch.setattr(topics, "CHUNK_TERMS", 3)
    assert pick(topics.fit_topics(table, "k", ("all",), passes=1)[1]) == whole


def test_a_second_run_is_the_same(spark, table):
    one, two = (topics.fit_topics(table, "k", ("all",), passes=2)[0] for _ in range(2))
    pick = lambda f: sorted((r.term, *[round(r[f"topic_{i}"], 9) for i in range(4)]) for r in f.collect())
    assert pick(one) == pick(two)


def test_start_is_close_to_a_gamma_with_mean_one(spark):
    values = (
        spark.range(20000)
        .select(F.lit("c").alias("corpus"), F.col("id").cast("string").alias("term"))
        .select(topics._start(0, 42).alias("v"))
        .agg(F.avg("v").alias("m"), F.stddev("v").alias("s"), F.skewness("v").alias("g"))
        .first()
    )
    assert values.m == pytest.approx(1.0, abs=0.005)
    assert values.s == pytest.approx(0.1, abs=0.005)
    assert values.g == pytest.approx(0.2, abs=0.08)


def test_digamma(spark):
    euler = 0.5772156649015329
    assert special.digamma(1.0) == pytest.approx(-euler, abs=1e-9)
    assert special.digamma(0.5) == pytest.approx(-euler - 2 * math.log(2), abs=1e-9)
    assert special.digamma(10.0) == pytest.approx(sum(1 / i for i in range(1, 10)) - euler, abs=1e-9)
    frame = spark.createDataFrame([(0.25,), (1.0,), (37.5,)], "x double")
    for row in frame.select("x", F.expr(special.digamma_sql("x")).alias("y")).collect():
        assert row.y == pytest.approx(float(special.digamma(row.x)), abs=1e-12)


def test_keyword_ranking_is_cut_before_the_shuffle(spark, table):
    names = [F.lit(float(i)).alias(f"topic_{i}") for i in range(4)]
    plan = (
        topics.topic_keywords(table.select("corpus", "term", *names))
        ._jdf.queryExecution().executedPlan().toString()
    )
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_hot_keys_are_few_and_split_evenly(spark):
    counts = spark.createDataFrame(
        [("hot", 50_000)] + [(f"k{i}", 10) for i in range(10_000)], "k string, n long"
    )
    found = skew.hot_keys(counts, ["k"], "n", least=1000, shares=100).collect()
    assert [(r.k, r.splits) for r in found] == [("hot", 34)]
    rows = spark.range(50_000).select(F.lit("hot").alias("k"), "id")
    hot = spark.createDataFrame([("hot", 34)], "k string, splits int")
    sizes = [r["count"] for r in skew.add_split(rows, hot, ["k"], "id").groupBy("split").count().collect()]
    assert len(sizes) == 34 and max(sizes) < 1.3 * 50_000 / 34
    assert skew.copy_per_split(hot.select("k"), hot, ["k"]).count() == 34


def test_terms_are_counted_within_their_document(spark):
    """Documents of a repeated or absent key are added up, all others are counted in their row."""
    rows = [("all", 1, "aa bb aa bb".split()), ("all", 2, "aa cc".split()), ("all", 2, "aa".split()),
            ("more", 2, ["aa"]), ("all", None, "dd dd".split()), ("all", None, ["dd"]),
            ("all", 3, []), ("all", 4, None), ("all", 5, ["issue"])]
    frame = spark.createDataFrame(rows, "corpus string, k int, tokens array<string>")
    counts = terms.term_counts(frame, "k")
    assert sorted(tuple(r) for r in counts.collect() if r.k) == [
        ("all", 1, "aa", 2), ("all", 1, "aa bb", 2), ("all", 1, "bb", 2), ("all", 1, "bb aa", 1),
        ("all", 2, "aa", 2), ("all", 2, "aa cc", 1), ("all", 2, "cc", 1), ("more", 2, "aa", 1),
    ]
    assert sorted((r.term, r.tf) for r in counts.collect() if r.k is None) == [("dd", 3), ("dd dd", 1)]
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    grouped = [line for line in plan.splitlines() if "Aggregate [" in line]
    assert len(grouped) == 1 and "sum(tf" in grouped[0]


def test_only_terms_that_can_be_keywords_are_ranked(spark):
    masses = [F.col("id").cast("double"), F.lit(1.0), -F.col("id").cast("double"), F.lit(None).cast("double")]
    frame = spark.range(20_000).select(
        F.lit("c").alias("corpus"), F.format_string("t%05d", "id").alias("term"),
        *[m.alias(f"topic_{i}") for i, m in enumerate(masses)],
    )
    kept = topics._contenders(frame, ["topic_0", "topic_2"], 5)
    assert 5 <= kept.where("topic = 0").count() < 1000 and 5 <= kept.where("topic = 1").count() < 1000
    found = {r.topic: r.keywords for r in topics.topic_keywords(frame).collect()}
    first = [f"t{i:05d}" for i in range(5)]
    assert found == {0: [f"t{i:05d}" for i in range(19_999, 19_994, -1)], 1: first, 2: first, 3: first}
    few = topics.topic_keywords(frame.where("id < 3")).collect()
    assert {r.topic: r.keywords for r in few}[0] == ["t00002", "t00001", "t00000"]


def test_only_the_kept_terms_are_written_before_the_weights(spark, monkeypatch):
    written = []
    monkeypatch.setattr(terms, "durable", lambda frame: written.append(frame.columns) or frame)
    terms.tfidf_by_split(docs(spark), "k", ("all",))
    assert written == [["corpus", "term", "df", "idf"]]


def test_a_pass_moves_a_term_once_per_block(spark, table, monkeypatch):
    """Whatever the blocks, the model is the same, and only terms of a block go to it and come back."""
    monkeypatch.setattr(topics, "LEAST_BLOCK_WEIGHTS", 7)
    given, gather = [], topics._gather_terms
    monkeypatch.setattr(topics, "_gather_terms", lambda f, names: given.append(f.count()) or gather(f, names))
    masses, mixtures = topics.fit_topics(table, "k", ("all",), passes=2)
    assert given[0] == given[1] < table.count()
    monkeypatch.setattr(topics, "LEAST_BLOCK_WEIGHTS", 10**9)
    whole_masses, whole_mixtures = topics.fit_topics(table, "k", ("all",), passes=2)
    assert given[2] == masses.count() == whole_masses.count()
    pick = lambda f: {r.term: [r[f"topic_{i}"] for i in range(4)] for r in f.collect()}
    one, two = pick(masses), pick(whole_masses)
    assert one.keys() == two.keys() and all(one[t] == pytest.approx(two[t], rel=1e-9) for t in one)
    shares = lambda f: {r.k: r.mixture for r in f.collect()}
    one, two = shares(mixtures), shares(whole_mixtures)
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k], rel=1e-9) for k in one)


def test_a_pass_moves_one_row_per_shelf_and_block(spark, table, monkeypatch):
    """However many terms a shelf holds, the model is the same."""
    monkeypatch.setattr(topics, "LEAST_BLOCK_WEIGHTS", 7)
    whole, _ = topics.fit_topics(table, "k", ("all",), passes=2)
    monkeypatch.setattr(topics, "LEAST_SHELVES", 0)
    monkeypatch.setattr(topics, "SHELF_TERMS", 6)
    shelves = math.ceil(whole.count() / 6)
    given, gather = [], topics._gather_terms
    moved = lambda f: [tuple(r) for r in f.select("shelf", "block").collect()]
    monkeypatch.setattr(topics, "_gather_terms", lambda f, names: given.append(moved(f)) or gather(f, names))
    packed, _ = topics.fit_topics(table, "k", ("all",), passes=2)
    blocks = len({block for _, block in given[0]})
    assert 1 < shelves and 1 < blocks and len(given[0]) <= shelves * blocks < table.count()
    assert len(set(given[0])) == len(given[0])
    pick = lambda f: {r.term: [r[f"topic_{i}"] for i in range(4)] for r in f.collect()}
    one, two = pick(whole), pick(packed)
    assert one.keys() == two.keys() and all(one[t] == pytest.approx(two[t], rel=1e-9) for t in one)


def test_the_model_brings_weights_to_unit_length(spark, table):
    words, weighted = terms.numbered_weights(docs(spark), "k", ("all",))
    raw = weighted.select("corpus", "k", "term_id", F.col("raw").alias("weight"))
    own = topics.fit_topics(raw, "k", ("all",), passes=1, vocabulary=words, unit_length=True)
    given = topics.fit_topics(table, "k", ("all",), passes=1)
    pick = lambda f: {r[1]: [*r[2]] if isinstance(r[2], list) else [*r[2:]] for r in f.collect()}
    for one, two in zip(map(pick, own), map(pick, given)):
        assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k], rel=1e-9) for k in one)


def test_documents_of_known_unique_keys_are_not_looked_up(spark):
    whole, known = terms.term_counts(docs(spark), "k"), terms.term_counts(docs(spark), "k", unique=True)
    assert sorted(map(tuple, known.collect())) == sorted(map(tuple, whole.collect()))
    plan = known._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Union" not in plan


def test_documents_of_like_size_settle_together(monkeypatch):
    """Chunks are rows of weights with little filling, and every document settles as it would alone."""
    generator = np.random.default_rng(1)
    sizes = np.array([1, 900, 3, 40, 1, 41, 7, 300, 2, 45, 1, 44], dtype=np.int32)
    weight, beta = generator.random(sizes.sum()) + 0.1, generator.random((4, sizes.sum()))
    shapes, settle = [], topics._settled_chunk
    monkeypatch.setattr(topics, "_settled_chunk", lambda w, *rest: shapes.append(w.shape) or settle(w, *rest))
    found = topics._settled(weight, beta, sizes, 0.25)
    assert all(len(shape) == 2 for shape in shapes) and max(shape[0] for shape in shapes) >= 3
    assert sizes.sum() <= sum(rows * longest for rows, longest in shapes) <= 1.2 * sizes.sum()
    for document, (end, size) in enumerate(zip(np.cumsum(sizes), sizes)):
        own, gamma = slice(end - size, end), np.ones(4)
        for _ in range(topics.MIXTURE_STEPS):
            theta = np.exp(special.digamma(gamma) - special.digamma(gamma.sum()))
            share = weight[own] / (theta @ beta[:, own] + topics.TINY)
            last, gamma = gamma, 0.25 + theta * (beta[:, own] @ share)
            if np.abs(gamma - last).mean() < topics.MIXTURE_TOLERANCE:
                break
        assert found[:, document] == pytest.approx(gamma, rel=1e-9)


def weights_of(frame):
    return sorted(
        (r.corpus, -1 if r.k is None else r.k, r.term, r.tf, r.df, round(r.idf, 12), round(r.weight, 12))
        for r in frame.collect()
    )


def test_only_packed_terms_are_shuffled_for_the_weights(spark):
    """No exchange of the plan has a row per document and term, nor is one keyed by either."""
    plan = terms.tfidf(docs(spark), "k", ("all",))._jdf.queryExecution().executedPlan().toString()
    keyed = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert keyed and not any(re.search(r"\b(term|k)#", line) for line in keyed)
    assert "Window" not in plan and "Generate" not in plan


@pytest.mark.parametrize("tokens, shelf", [(1, 1), (7, 5), (10**6, 10**6)])
def test_blocks_and_shelves_change_no_weight(spark, monkeypatch, tokens, shelf):
    monkeypatch.setattr(term_blocks, "BLOCK_TOKENS", tokens)
    monkeypatch.setattr(term_blocks, "SHELF_TERMS", shelf)
    monkeypatch.setattr(term_blocks, "OUT_ROWS", 3)
    found = terms.tfidf(docs(spark).coalesce(1), "k", ("all",)).collect()
    expected = expected_weights()
    assert {(r.k, r.term) for r in found} == set(expected) and len(found) == len(expected)
    assert all(r.weight == pytest.approx(expected[r.k, r.term], abs=1e-12) for r in found)


@pytest.mark.parametrize("places", [1, 1 << 16])
def test_weights_of_odd_documents_are_those_of_their_rows(spark, monkeypatch, places):
    """Repeated and absent keys, words with spaces in them, empty documents, corpora not asked for."""
    monkeypatch.setattr(terms, "KEY_PLACES", places)
    monkeypatch.setattr(term_blocks, "BLOCK_TOKENS", 4)
    rows = [("all", k, t.split()) for k, t in TEXTS.items()]
    rows += [("more", k, t.split()) for k, t in TEXTS.items() if k < 6]
    rows += [("all", 3, "alpha beta".split()), ("all", None, "beta beta".split()), ("all", None, ["beta", "omega"]),
             ("more", 3, "zeta beta".split()), ("all", 20, ["new york", "city", "new", "york"]),
             ("all", 21, ["new", "york city", " x", "a  b", "ünï"]), ("all", 22, ["new", "york", "city", "ünï"]),
             ("all", 23, ["new york", "city", "a ", " b", " x"]), ("all", 24, []), ("all", 25, None),
             ("all", 26, ["issue", "a"]), ("all", 27, ["alpha", None, "beta"]), ("other", 1, ["alpha", "beta"]),
             ("other", 2, ["alpha", "beta"]), (None, 1, ["alpha"]), (None, 2, ["alpha"])]
    frame = spark.createDataFrame(rows, "corpus string, k int, tokens array<string>")
    for options in ({}, {"min_docs": 1, "max_share": 1.0}, {"stop_words": ("alpha",)}):
        found = terms.tfidf(frame, "k", ("all", "more"), **options)
        plain = terms.tfidf_by_split(frame, "k", ("all", "more"), **options).drop("term_id", "split", "splits")
        assert found.dtypes == plain.dtypes
        assert weights_of(found) == weights_of(plain)
    assert weights_of(terms.tfidf(frame.where("k > 99"), "k", ("all",))) == []


def test_repeated_words_are_sent_once_per_block(spark):
    """A block keeps its words once, whatever the number of rows, and is far smaller than its text."""
    rows = spark.range(3000).select(
        F.lit("all").alias("corpus"), F.col("id").alias("k"),
        F.transform(F.sequence(F.lit(0), F.lit(49)), lambda i: F.concat(F.lit("word"), (i * F.col("id")) % 997)).alias("tokens"),
        F.lit(1).cast("long").alias("times"), F.lit(True).alias("whole"),
    )
    block = term_blocks.cut_into_blocks(rows.coalesce(1)).collect()
    assert [r.tokens for r in block] == [150_000]
    packed = sum(len(value) for value in block[0] if isinstance(value, (bytes, bytearray)))
    assert packed < 2.5 * 150_000
    assert len(term_blocks._strings(bytes(block[0].spans), bytes(block[0].letters))) == 997
