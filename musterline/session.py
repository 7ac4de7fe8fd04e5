"""Session defaults and durable cut points for long lineages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(
    app_name: str = "musterline",
    master: str | None = None,
    settings: dict[str, str] | None = None,
) -> SparkSession:
    """Build a session; `settings` go on top of the defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_DEFAULTS, **(settings or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` by a reliable checkpoint.

    The folder is the one the cluster names in `spark.checkpoint.dir`; without it
    there is an error, as a machine-local folder would be lost with its executor.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            raise RuntimeError(
                "spark.checkpoint.dir is not set: name a shared folder for checkpoints"
            )
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder under the shared one, for files that later jobs read."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise RuntimeError("spark.checkpoint.dir is not set: name a shared folder")
    return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"
