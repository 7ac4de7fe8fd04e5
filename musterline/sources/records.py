"""CSV files whose quoted cells hold line breaks, read by many tasks.

A line starts inside a quoted cell if the number of quotes before it in its file is odd; a
quote inside a cell is written twice and changes nothing. So quotes are counted per file block,
the parity of their running sum says how each block starts, and every block then finds its
own record starts. A record that crosses the end of a block leaves pieces in both;
the pieces, at most two a block, are put together apart.

Files are scanned as lines three times: to count quotes, to gather pieces, to read records. What
is broadcast is one hash and one number per block that starts inside a cell, 16 bytes for
some 128 MB of input. Lines end with a line feed, or carriage return and line feed; in a record
that ends with both, so do breaks inside cells, and they are read as line feeds. A quote that
is never closed takes in the rest of its file, as in any CSV reader.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from musterline.session import durable

# What a row of `_pieces` is: a whole record, or its first, a further or its last part.
WHOLE, FIRST, MORE, LAST = 0, 1, 2, 3
HEADER_LINES = 200


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, block, value of every line; lines of a block come in order."""
    return spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        "value",
    )


def _header(spark: SparkSession, path: str | list[str]) -> list[str]:
    """Cells of the first record of the first file with one."""
    record = ""
    for row in spark.read.text(path, lineSep="\n").take(HEADER_LINES):
        record += row["value"].rstrip("\r") if not record else "\n" + row["value"]
        if record.strip() and record.count('"') % 2 == 0:
            break
    cells = next(csv.reader(io.StringIO(record.lstrip("\ufeff"), newline="")), [])
    if not cells:
        raise ValueError(f"no header in {path}")
    return cells


def _starts(lines: DataFrame) -> DataFrame:
    """file_hash, block of every block, and whether it starts `inside` a quoted cell."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"')))
    counted = lines.groupBy("file", "block").agg(F.sum(quotes).alias("quotes"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    return durable(
        counted.select(
            F.xxhash64("file").alias("file_hash"),
            "block",
            (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside"),
        )
    )


def _pieces(lines: DataFrame, starts: DataFrame, header: list[str]) -> DataFrame:
    """file, block, row, kind, text of every record or piece of one, without headers and blanks."""
    odd = F.broadcast(starts.where("inside"))
    known = lines.withColumn("file_hash", F.xxhash64("file")).join(odd, ["file_hash", "block"], "left")
    inside = known.select("file", "block", F.col("inside").isNotNull().alias("inside"), "value")
    out = pa.schema(
        [("file", pa.string()), ("block", pa.int64()), ("row", pa.int64()), ("kind", pa.int32()), ("text", pa.string())]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, odd_now, number, later, first = None, [], False, 0, False, False
        rows: list[tuple] = []

        def emit(text: str, kind: int) -> None:
            nonlocal number, first
            if kind in (0, 1) and not text.strip("\r\n\t "):
                return
            if first and kind in (0, 1):
                first = False
                if kind == 0:
                    own = next(csv.reader(io.StringIO(text.lstrip("\ufeff"), newline="")), [])
                    if own != header:
                        raise ValueError(f"{key[0]} has the header {own}, others have {header}")
                    return
            rows.append((*key, number if kind in (0, 1) else -1, kind, text))
            number += 1

        def close() -> None:
            """The end of a block: what is open goes on in the next one."""
            if held:
                emit("\n".join(held), 2 if later else 1)

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [[]] * 5
            rows_out = pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, out)], schema=out
            )
            rows.clear()
            return rows_out

        for batch in batches:
            files, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            insides, values = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for file, block, starts_inside, value in zip(files, blocks, insides, values):
                if (file, block) != key:
                    if key is not None:
                        close()
                    key, held, odd_now, number = (file, block), [], starts_inside, 0
                    # The first record of a block may belong to an earlier one.
                    later, first = starts_inside, block == 0
                held.append(value)
                if value.count('"') % 2:
                    odd_now = not odd_now
                if not odd_now:
                    text = "\n".join(held)
                    if not later and text.endswith("\r"):
                        text = text[:-1].replace("\r\n", "\n")
                    emit(text, 3 if later else 0)
                    held, later = [], False
            yield flush()
        if key is not None:
            close()
            yield flush()

    return inside.mapInArrow(cut, "file string, block long, row long, kind int, text string")


def records(spark: SparkSession, path: str | list[str]) -> tuple[list[str], DataFrame]:
    """The header's cells, and file, block, row, text of every record after it."""
    header = _header(spark, path)
    lines = _lines(spark, path)
    starts = _starts(lines)
    pieces = durable(_pieces(lines, starts, header).where(F.col("kind") != WHOLE))
    # A record's pieces follow its first one; a last piece is row -1 of its block.
    inside = W.partitionBy("file").orderBy("block", "row").rowsBetween(W.unboundedPreceding, 0)
    chained = pieces.withColumn("record", F.sum((F.col("kind") == FIRST).cast("long")).over(inside))
    text = F.array_join("parts.text", "\n")
    plain = F.expr(r"replace(rtrim('\r', text), '\r\n', '\n')")
    seams = (
        chained.groupBy("file", "record")
        .agg(F.array_sort(F.collect_list(F.struct("block", "row", "text"))).alias("parts"))
        .select(
            "file",
            F.col("parts")[0]["block"].alias("block"),
            F.col("parts")[0]["row"].alias("row"),
            text.alias("text"),
        )
        .withColumn("text", F.when(F.col("text").endswith("\r"), plain).otherwise(F.col("text")))
    )
    whole = _pieces(lines, starts, header).where(F.col("kind") == WHOLE)
    return header, whole.select("file", "block", "row", "text").unionByName(seams)


def read_records(spark: SparkSession, path: str | list[str], names: list[str]) -> DataFrame:
    """The cells of every record as text columns `names`, and `row_order` (unless a name)."""
    _, found = records(spark, path)
    kinds = ", ".join(f"`{name.replace('`', '``')}` STRING" for name in names)
    # Whatever a record's length, cells are read as the CSV source reads them.
    options = {"escape": '"', "maxCharsPerColumn": "-1"}
    cells = found.select(
        F.from_csv("text", kinds, options).alias("cells"),
        F.struct("file", "block", "row").alias("row_order"),
    )
    return cells.select("cells.*", *([] if "row_order" in names else ["row_order"]))
