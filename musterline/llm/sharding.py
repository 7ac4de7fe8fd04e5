"""Sharding by a two-pass external shuffle, in DataFrame operations only.

A shard is the one whose seeded hash with the id is highest, so the id and the number of shards
decide, and one more shard takes rows only into itself. Pass one scatters the
records of each shard uniformly into buckets that fit a task's memory, by seeded hashes. Pass
two shuffles each bucket (Spark's `shuffle` is a seeded Fisher-Yates shuffle) and
numbers its records after those of the buckets before it.

Records travel as (id, row hash, copy) in both passes. Equal rows are counted before the
shuffle and get a copy number, so a row repeated any number of times still spreads over all
buckets of its shard. `sharded` brings the rows themselves to their places.

Defined cases: rows with a null id share one shard (the law knows only the id) but spread over its
buckets; a null text has 16 bytes and crc32 0; ties cannot occur, as the shuffle starts
from a sorted bucket; reruns with the same settings agree; an empty table gives an empty result;
extra columns, whatever their names, pass through `sharded` (see there for shard and slot).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from musterline.llm.common import each_copy, free_name, kept, quoted, whole_rows

SHARDS = 40
SEED = 20_231
# Mean bytes of a shard's buckets; a row counts at least 16, so that is a million rows at most.
BUCKET_BYTES = 16 << 20
ROW_BYTES = 16


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def shards_of(doc_id: Column, shards: int, seed: int = SEED) -> Column:
    """struct(now, grown): the shard among `shards` and among one more."""
    tickets = F.transform(
        F.sequence(F.lit(0), F.lit(shards)),
        lambda s: F.struct(F.xxhash64(F.lit(seed), s, doc_id).alias("h"), s.alias("s")),
    )
    return F.struct(
        F.array_max(F.slice(tickets, 1, shards))["s"].alias("now"),
        F.array_max(tickets)["s"].alias("grown"),
    )


def row_hash(docs: DataFrame) -> Column:
    """Hash of a whole row; maps, which have no order, enter as their sorted entries."""
    columns = [
        F.array_sort(F.map_entries(quoted(name))) if kind.startswith("map") else quoted(name)
        for name, kind in docs.dtypes
    ]
    # Null and empty columns must differ, so which are null enters as well.
    return F.xxhash64(*columns, *[c.isNull() for c in columns])


def records(docs: DataFrame, shards: int, seed: int) -> DataFrame:
    """Distinct rows as narrow records with their number of copies."""
    return (
        docs.select(
            "doc_id",
            row_hash(docs).alias("row_hash"),
            size_of(F.col("text")).alias("size"),
            F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        )
        .groupBy("doc_id", "row_hash", "size", "text_crc32")
        .agg(F.count("*").alias("copies"))
        .withColumn("shard", shards_of(F.col("doc_id"), shards, seed))
        .select("*", F.col("shard.now").alias("now"), F.col("shard.grown").alias("grown_shard"))
        .drop("shard")
        .withColumnRenamed("now", "shard")
    )


def place(
    docs: DataFrame, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED
) -> DataFrame:
    """doc_id, row_hash, copy, size, text_crc32, shard, bucket, slot and grown_shard per row."""
    spark = docs.sparkSession
    rows = kept(records(docs, shards, seed))
    # One row per shard. A shard that holds a hot id has more buckets, not larger ones.
    totals = (
        rows.groupBy("shard")
        .agg(F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.sum("copies").alias("rows"))
        .collect()
    )
    counts = [1] * shards
    for own in totals:
        counts[own["shard"]] = max(1, math.ceil(own["bytes"] / bucket_bytes))
    buckets = F.get(F.array(*map(F.lit, counts)), F.col("shard"))
    parts = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        math.ceil(sum(own["rows"] for own in totals) / 1e6),
    )
    copies = each_copy(rows, F.col("copies"))
    spread = F.xxhash64(F.lit(seed + 1), "doc_id", "row_hash", "copy")
    scattered = copies.withColumn("bucket", F.pmod(spread, buckets).cast("int"))
    record = F.struct("doc_id", "row_hash", "copy", "size", "text_crc32", "grown_shard")
    # Pass one ends in one array per bucket. The number of partitions is fixed and buckets are
    # sorted, so the seeded shuffle meets the same arrays in the same order in every run.
    grouped = (
        scattered.repartition(parts, "shard", "bucket")
        .groupBy("shard", "bucket")
        .agg(F.array_sort(F.collect_list(record)).alias("held"))
        .sortWithinPartitions("shard", "bucket")
    )
    mixed = grouped.select("shard", "bucket", F.shuffle("held", F.lit(seed)).alias("held"))
    shuffled = kept(
        mixed.select("shard", "bucket", F.posexplode("held").alias("place", "r")).select(
            "shard", "bucket", "place", "r.*"
        )
    )
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        shuffled.groupBy("shard", "bucket")
        .agg(F.count("*").alias("n"))
        .select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    return (
        shuffled.join(offsets, ["shard", "bucket"])
        .withColumn("slot", F.col("offset") + F.col("place"))
        .drop("offset", "place")
    )


def sharded(
    docs: DataFrame, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED
) -> DataFrame:
    """The rows of `docs` with shard and slot, ready to be written bucket by bucket.

    Rows come in the order of their slots within a task; a bucket lies in one task. A table's
    own column named shard or slot is kept as `shard_input` or `slot_input`.
    """
    own = docs.columns
    names = [
        free_name(name, ["shard", "slot", *(o for o in own if o != name)])
        if name.lower() in ("shard", "slot")
        else name
        for name in own
    ]
    places = place(docs, shards, bucket_bytes, seed).select(
        F.col("doc_id").alias("place_id"),
        F.col("row_hash").alias("place_hash"),
        "bucket",
        "shard",
        "slot",
    )
    rows = whole_rows(docs, id="doc_id", row_hash=row_hash(docs))
    # Copies of a row are equal in every column: one is kept and meets all their places.
    single = rows.dropDuplicates(["id", "row_hash"])
    same = single["id"].eqNullSafe(places["place_id"]) & (
        single["row_hash"] == places["place_hash"]
    )
    return (
        single.join(places, same)
        .repartition("shard", "bucket")
        .sortWithinPartitions("shard", "slot")
        .select(
            *[F.col("row").getField(o).alias(name) for o, name in zip(own, names)], "shard", "slot"
        )
    )


def write(docs: DataFrame, folder: str, **options) -> None:
    """Write the shuffled rows, one folder per shard."""
    sharded(docs, **options).write.partitionBy("shard").parquet(folder)
