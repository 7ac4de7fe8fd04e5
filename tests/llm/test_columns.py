"""Extra columns of any name: no operator or stage fails on them or changes their values."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from musterline.llm import (
    decontaminate,
    language_id,
    mixing,
    quality,
    rules,
    sharding,
    simhash,
    token_counts,
    toxicity,
)

SMALL = "/root/testdata/sf0.001"
NAMES = """a.b score row id size text_hash words own part bucket copy held_out key lang_pred figures label
__score __size __source __epochs __text_hash __row __key __block __part __edge __w __id first_id bad_id
fingerprint n_chars_input own.x""".split() + ["back`tick", "two words"]


@pytest.fixture(scope="module")
def wide(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(80)
    # Every extra value is a number that the id and the column's place give.
    extra = [
        (F.col("doc_id") * 100 + n).alias(name) for n, name in enumerate(NAMES)
    ]
    return docs.select(
        "*", *extra, F.col("doc_id").alias("shard"), F.col("doc_id").alias("SLOT")
    )


def unchanged(out, names):
    rows = out.collect()
    assert rows
    for row in rows:
        values = row.asDict()
        assert all(values[name] == values["doc_id"] * 100 + n for n, name in enumerate(NAMES))
    assert out.columns == names


@pytest.mark.parametrize("number", range(5))
def test_stages(spark, wide, number):
    name, stage = corpus_pipeline.STAGES[number]
    out = stage(spark, wide, SMALL)
    if name == "sharding":
        names = [{"shard": "shard_input", "SLOT": "SLOT_input"}.get(c, c) for c in wide.columns]
        unchanged(out, [*names, "shard", "slot"])
        assert all(r["shard_input"] == r["doc_id"] == r["SLOT_input"] for r in out.collect())
    else:
        unchanged(out, wide.columns)
        assert all(r["shard"] == r["doc_id"] for r in out.collect())


def test_rules_clean(wide):
    unchanged(rules.clean(wide), wide.columns)


def test_operators_that_give_rows_of_their_own(spark, wide):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    number = wide.count()
    scored = quality.score(wide, quality.fit(wide, labels), ["doc_id", "score", "a.b", "back`tick"])
    assert scored.columns == ["doc_id", "score_input", "a.b", "back`tick", "score"]
    assert all(r["score_input"] == r["doc_id"] * 100 + NAMES.index("score") for r in scored.collect())
    counted = token_counts.counts(
        wide, token_counts.spread_edits(F.col("text")), ["doc_id", "n_chars", "a.b"], token_counts.ranks()
    )
    assert counted.columns[:3] == ["doc_id", "n_chars_input", "a.b"] and counted.count() == number
    assert simhash.near_duplicates(wide).count() == number
    assert decontaminate.contamination(wide, bench.withColumn("a.b", F.lit(1))).count() <= number
    assert rules.judge(wide).count() == number
    assert mixing.taken(mixing.plan(wide)).count() == number
    assert sharding.place(wide).count() == number
    model = toxicity.fit(wide, labels)
    assert wide.select(toxicity.score_of(wide, model).alias("s")).count() == number
    field = language_id.fit(wide)
    assert wide.select(language_id.predicted(wide, field).alias("s")).count() == number
