"""Readers for attendance grids and exit answers.

Both read CSV or Parquet by path or glob, all CSV cells as text. Each row gets
`row_order`, its place in the input by file and position, which the
first-non-null operators need after a shuffle.
"""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, functions as F

from musterline.sources.records import read_records

ROW_ORDER = "row_order"
# Headers read at the same time.
AT_ONCE = 16


def read_grid(spark: SparkSession, path: str | list[str], fmt: str = "csv") -> DataFrame:
    """Wide employee x day grid of files with one header.

    A CSV file with another header than the first is an error when it is read, not a source of
    shifted cells; `read_grids` takes such files. Parquet columns are joined by name.
    """
    return _read(spark, path, fmt)


def read_grids(spark: SparkSession, path: str | list[str], fmt: str = "csv") -> list[DataFrame]:
    """Wide grids, one per header: files whose headers agree are scanned together.

    Reads the header of every file once (the first line, or a Parquet footer); no data are read for
    that. Files keep their order over all grids through `row_order`. Empty files are left out.
    """
    _check_format(fmt)
    files = _files(spark, path)
    with ThreadPoolExecutor(AT_ONCE) as pool:
        headers = list(pool.map(lambda file: _header(spark, file, fmt), files))
    groups: dict[tuple, list[str]] = {}
    for file, header in zip(files, headers):
        if header:
            groups.setdefault(header, []).append(file)
    if not groups:
        raise ValueError(f"no file with a header under {path}")
    return [_read(spark, group, fmt) for group in groups.values()]


def _files(spark: SparkSession, path: str | list[str]) -> list[str]:
    """The files under a path or glob, by name, as paths in which no character is a pattern."""
    paths = [path] if isinstance(path, str) else list(path)
    # Only the listing: the content column is not asked for.
    listed = spark.read.format("binaryFile").load(paths).select("path").distinct()
    names = sorted(row["path"] for row in listed.collect())
    return [re.sub(r"([\\\[\]{}*?])", r"\\\1", name) for name in names]


def _header(spark: SparkSession, file: str, fmt: str) -> tuple:
    """What tells a group: column names, for Parquet with their types."""
    if fmt == "csv":
        return tuple(spark.read.option("header", True).option("escape", '"').csv(file).columns)
    return tuple((f.name, f.dataType.simpleString()) for f in spark.read.parquet(file).schema)


def _check_format(fmt: str) -> None:
    if fmt not in ("csv", "parquet"):
        raise ValueError(f"unknown format {fmt!r}: use 'csv' or 'parquet'")


def read_answers(spark: SparkSession, path: str | list[str], fmt: str = "csv") -> DataFrame:
    """Long exit answers. CSV comments may hold line breaks; large files are read by many
    tasks all the same (see `records`)."""
    if fmt == "csv":
        header = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
        return with_row_order(read_records(spark, path, header.csv(path).columns))
    return _read(spark, path, fmt)


def _read(spark: SparkSession, path, fmt: str) -> DataFrame:
    _check_format(fmt)
    if fmt == "csv":
        frame = (
            spark.read.option("header", True)
            .option("enforceSchema", False)
            .option("escape", '"')
            .csv(path)
        )
    else:
        paths = [path] if isinstance(path, str) else path
        frame = spark.read.option("mergeSchema", True).parquet(*paths)
    return with_row_order(frame)


def with_row_order(frame: DataFrame) -> DataFrame:
    """Place of each row: file, split within the file, row within the split.

    A file that numbers its rows itself keeps its own `row_order`."""
    if ROW_ORDER in frame.columns:
        if frame.schema[ROW_ORDER].dataType.typeName() == "struct":
            return frame
        return frame.withColumn(ROW_ORDER, F.col(ROW_ORDER).cast("long"))
    return frame.select(
        "*",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias(ROW_ORDER),
    )
