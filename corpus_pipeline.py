"""The corpus pipeline: documents in, shards of a clean and mixed corpus out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from musterline.llm import decontaminate, mixing, sharding, simhash, toxicity
from musterline.llm.common import new_folder, read, remove_folder


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    model = toxicity.fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return toxicity.reject(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of linked fingerprints."""
    return simhash.deduplicate(docs, shingle=4, radius=4)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or cut to the target of their source."""
    return mixing.mixed(docs)


def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and their slot in it."""
    return sharding.sharded(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
    ("sharding", into_shards),
]

# The first stages are a trained classifier and hashes that DuckDB lacks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written as Parquet and read by the next.

    A stage's result is removed once that of the next one is complete; the last stays.
    """
    docs = read(spark, sf_dir, "documents")
    folder = new_folder(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        out = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if number:
            remove_folder(f"{folder}/{number - 1}")
    return docs
