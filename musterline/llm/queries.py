"""The registered queries: thin readings of each operator over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from musterline.llm import (
    decontaminate,
    hard_negatives,
    language_id,
    mixing,
    oracles,
    prefix_trie,
    quality,
    rules,
    sharding,
    simhash,
    token_counts,
    toxicity,
    url_filter,
    warc,
)
from musterline.llm.common import in_fold, read
from musterline.llm.registry import query

ACCEPT = 0.3


@query("op1_quality")
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, model, ["doc_id"]).select(
        "doc_id",
        in_fold(F.col("doc_id"), 5, 0).alias("held_out"),
        "score",
        (F.col("score") >= ACCEPT).cast("int").alias("predicted"),
    )


@query("op2_mixing", oracles.MIXING)
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.plan(read(spark, sf_dir, "documents")))


@query("op3_decontamination", oracles.DECONTAMINATION)
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontaminate.contamination(
        read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    )
    return judged.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op4_sharding")
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(read(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        "slot",
        "grown_shard",
    )


@query("op5_rules", oracles.RULES)
def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(read(spark, sf_dir, "documents"))


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", "lang", toxicity.score_of(docs, model).alias("score"))
    threshold = toxicity.threshold_of(model, F.col("lang"))
    return scored.select(
        "doc_id",
        in_fold(F.col("doc_id"), 4, 2).alias("held_out"),
        "score",
        (F.col("score") >= ACCEPT).cast("int").alias("predicted"),
        threshold.alias("threshold"),
        (F.col("score") >= threshold).alias("rejected"),
    )


@query("op7_warc", oracles.WARC)
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(spark, read(spark, sf_dir, "pages"), with_payload=False)
    return records.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    edits = token_counts.spread_edits(F.col("text"))
    return token_counts.counts(docs, edits, ["doc_id"], token_counts.ranks())


@query("op9_urls", oracles.URLS)
def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages")).select(
        "page_id", "host", "path", "rule", "verdict"
    )


@query("op10_simhash")
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=4, radius=4)


@query("op13_prefix_trie", oracles.PREFIX_TRIE)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = prefix_trie.shared_openings(read(spark, sf_dir, "conversations"), group=5, most=8)
    return prefix_trie.trie(paths).drop("ka", "kb")


@query("op12_hard_negatives", oracles.HARD_NEGATIVES)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(
        rows.select(
            F.col("vec_id").alias("id"),
            moved.alias("label"),
            hard_negatives.whole_vectors(rows, "embedding").alias("vec"),
        ),
        F.col("id") % 100 == 0,
    )


@query("op11_language_id")
def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = language_id.predicted(docs, language_id.fit(docs))
    return docs.select("doc_id", found.alias("found")).select(
        "doc_id",
        in_fold(F.col("doc_id"), 4, 2).alias("held_out"),
        "found.lang_pred",
        "found.score",
    )
