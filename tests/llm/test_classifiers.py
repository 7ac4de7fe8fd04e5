import numpy as np
import pytest
from pyspark.sql import functions as F

from musterline.llm import quality, samples, toxicity, toxicity_net
from musterline.llm.common import remainder
from musterline.llm.queries import op1_quality, op6_toxicity

TABLES = "/root/testdata/sf0.1"


def accuracy(spark, query, label):
    scored = query(spark, TABLES).toPandas()
    labels = spark.read.parquet(f"{TABLES}/labels.parquet").toPandas()
    held = scored[scored.held_out].merge(labels, on="doc_id")
    assert len(held) > 300
    assert scored.score.between(0, 1).all()
    return (held.predicted == held[label]).mean()


def test_quality_on_held_out_rows(spark):
    assert accuracy(spark, op1_quality, "quality") > 0.97


def test_toxicity_on_held_out_rows(spark):
    assert accuracy(spark, op6_toxicity, "toxic") > 0.97


@pytest.fixture(scope="module")
def labelled(docs_of, spark):
    """Texts whose class shows in their words: `bad` ones shout, `rude` ones insult."""
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(400):
        words = [f"w{rng.integers(300)}" for _ in range(40)]
        kind = i % 2
        if kind:
            words[7] = f"rude{rng.integers(5)}"
        text = " ".join(words)
        rows.append((i, text if i % 4 < 2 else text.upper().replace(" ", "!! ")))
        labels.append((i, int(i % 4 < 2), kind))
    return docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_odd_rows_are_scored(labelled, docs_of, odd_rows):
    docs, labels = labelled
    odd = docs_of(odd_rows)
    model = quality.fit(docs, labels)
    scored = quality.score(odd, model, ["doc_id", "source"]).collect()
    assert len(scored) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in scored)
    net = toxicity.fit(docs, labels)
    assert toxicity.reject(odd, net).columns == odd.columns
    assert toxicity.reject(odd, net).count() >= len(odd_rows) - 1


def test_rude_words_are_found(labelled):
    docs, labels = labelled
    kept = {r["doc_id"] for r in toxicity.reject(docs, toxicity.fit(docs, labels)).collect()}
    wrong = sum((i in kept) == bool(i % 2) for i in range(400))
    assert wrong <= 8


def test_without_a_class_nothing_is_judged(labelled):
    docs, labels = labelled
    clean = labels.where("toxic = 0 and quality = 1")
    assert toxicity.reject(docs, toxicity.fit(docs, clean)).count() == 400
    scores = quality.score(docs, quality.fit(docs, clean), ["doc_id"]).select("score").distinct()
    assert [r["score"] for r in scores.collect()] == [0.5]


def test_disputed_null_and_repeated_labels(spark, labelled):
    docs, labels = labelled
    odd = spark.createDataFrame(
        [(1, 1, 0), (1, 0, 0), (None, 1, 1), (3, None, None), (4, 1, 0), (4, 1, 0)], labels.schema
    )
    assert quality.fit(docs, odd).dictionaries == []


def test_long_texts_are_compressed_whole():
    model = quality.QualityModel([(b"a" * 100, b"b" * 100)], np.zeros(1))
    tool = quality.compressors(model)[0]
    rng = np.random.default_rng(1)
    noise = rng.integers(0, 256, 3 << 20, dtype=np.uint8).tobytes()
    assert quality.compressed(tool, noise) > 3 << 20


def test_pooling_equals_a_plain_loop():
    rng = np.random.default_rng(5)
    docs = [rng.integers(1, 50, (n, toxicity_net.PARTS)).astype(np.int32) for n in (1, 2, 3, 9)]
    net = toxicity_net.start(docs, np.array([0.0, 1, 0, 1]), seed=1)
    got = net.raw(docs, net.table())
    for doc, value in zip(docs, got):
        padded = np.vstack((doc, np.zeros((2, toxicity_net.PARTS), np.int32)))
        x = net.embedding[padded].sum(1)
        pooled = []
        for k in toxicity_net.WIDTHS:
            conv = np.array(
                [sum(x[s + o] @ net.filters[k][o] for o in range(k)) for s in range(len(doc))]
            )
            pooled.append(np.maximum(conv.max(0) + net.biases[k], 0))
        assert value == pytest.approx(np.hstack(pooled) @ net.out + net.bias, abs=1e-4)


def test_thresholds_rest_on_all_rows_beyond_the_fitted_ones(labelled, spark):
    docs, labels = labelled
    # One language in forty, and rows without a language.
    lang = "case when doc_id % 40 < 2 then 'xx' when doc_id % 40 < 4 then null else 'en' end"
    docs = docs.withColumn("lang", F.expr(lang))
    model = toxicity.fit(docs, labels, sample_rows=50)
    sample = samples.labelled(docs, labels, "toxic", 4, 2, 50, 65_536, ["doc_id"])
    known = {row[2] for i, row in enumerate(sample) if i % 5 != 4}
    rows = docs.select(
        "doc_id", "lang", toxicity.score_of(docs, model).alias("score"), remainder(docs.doc_id, 4).alias("fold")
    ).collect()
    rows = [r for r in rows if r["fold"] != 2]
    free = [r for r in rows if r["doc_id"] not in known]
    assert len(free) == len(rows) - len(known) > 150
    counts = {r["lang"]: np.zeros((toxicity.STEPS, 2)) for r in free}
    for r in free:
        kind = r["doc_id"] % 2
        of_kind = [sum(x["doc_id"] % 2 == kind for x in some) for some in (rows, free)]
        step = min(int(r["score"] * toxicity.STEPS), toxicity.STEPS - 1)
        counts[r["lang"]][step, kind] += of_kind[0] / of_kind[1]
    common, own = toxicity.thresholds(counts)
    assert model.common == pytest.approx(common)
    assert set(model.thresholds) == {"en", "xx"} and model.thresholds == pytest.approx(own)


def test_a_language_moves_from_the_common_threshold_to_its_own():
    many, few = np.zeros((toxicity.STEPS, 2)), np.zeros((toxicity.STEPS, 2))
    many[[200, 600], [0, 1]] = 5000
    few[[500, 640], [0, 1]] = 1
    common, own = toxicity.thresholds({"many": many, "few": few})
    assert common == own["many"] and 0.2 < own["few"] < 0.61
    # With many rows of its own the cut lies between its own classes.
    common, own = toxicity.thresholds({"many": many, "few": few * 10_000})
    assert own["few"] > 0.501
    assert toxicity.thresholds({"one": np.zeros((toxicity.STEPS, 2))}) == (toxicity.COMMON, {})


def test_calibration_keeps_the_true_shares_beyond_the_cap(spark, docs_of):
    """Texts say nothing of their class, so a calibrated score is the share of the class."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{n}" for n in rng.integers(0, 40, 30))) for i in range(4000)]
    labels = [(i, int(i % 10 > 0), int(i % 10 == 0)) for i in range(4000)]
    docs, labels = docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels, sample_rows=250)
    good = quality.score(docs, model, ["doc_id"]).agg(F.avg("score")).first()[0]
    net = toxicity.fit(docs, labels, sample_rows=250)
    toxic = docs.select(toxicity.score_of(docs, net).alias("score")).agg(F.avg("score")).first()[0]
    assert good == pytest.approx(0.9, abs=0.1) and toxic == pytest.approx(0.1, abs=0.1)
