"""Small helpers that the operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import pyarrow.fs
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Fixed value: white space of the word rule (space, tab, line feed to carriage return).
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def by_value(*modules) -> None:
    """Send functions of these modules to Python workers by value.

    Workers then need no copy of this package: installing it on the driver is enough.
    """
    for module in modules:
        cloudpickle.register_pickle_by_value(module)


def send(spark: SparkSession, value) -> Broadcast:
    """Broadcast a value of any class by value; workers call `pickle.loads` on it.

    Only for values of a fixed size bound, such as the weights of a model.
    """
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as `spark.checkpoint.dir` names it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder all executors share")
    return folder.rstrip("/")


def kept(frame: DataFrame) -> DataFrame:
    """Write `frame` to the shared folder once; later reads start from these files."""
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(frame.sparkSession))
    return frame.checkpoint(eager=True)


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def remove_folder(folder: str) -> None:
    """Remove a folder of intermediate files, in any store that pyarrow.fs opens."""
    system, path = pyarrow.fs.FileSystem.from_uri(folder)
    system.delete_dir(path)


# Copies that one row of `each_copy` stands for before it is opened.
COPIES_AT_ONCE = 4096


def whole_rows(docs: DataFrame, **more: Column | str) -> DataFrame:
    """`row`, the whole row of `docs` as one column, and what is asked for beside it.

    An operator then works on names of its own, whatever the columns of the table are called;
    `select("row.*")` gives the table's own columns back.
    """
    asked = [(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in more.items()]
    return docs.select(F.struct("*").alias("row"), *asked)


def free_name(name: str, taken: Sequence[str]) -> str:
    """`name`, or if it is taken (in any case of letters) `name_input`, `name_input_input` ..."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_input"
    return name


def quoted(name: str) -> Column:
    """The column of this very name, dots and back-ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def each_copy(frame: DataFrame, copies: Column, name: str = "copy") -> DataFrame:
    """Every row once per copy, numbered from 1 in `name`.

    A row that stands for very many copies is opened in two steps, dealt out anew between
    them, so no array and no task holds them all.
    """
    parts = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    step = F.lit(COPIES_AT_ONCE).cast("long")
    last = F.floor((copies - 1) / COPIES_AT_ONCE)
    blocks = frame.where(copies > 0).withColumn(
        "__block", F.explode(F.sequence(F.lit(0).cast("long"), last))
    )
    inside = F.sequence(
        F.col("__block") * step + 1, F.least((F.col("__block") + 1) * step, copies.cast("long"))
    )
    return blocks.repartition(parts).withColumn(name, F.explode(inside)).drop("__block")


def add_words(frame: DataFrame, text: Column, name: str, spaces: str = SPACES) -> DataFrame:
    """Adds the words of a text as an array; null and blank texts have none.

    Cutting at runs of white space leaves an empty string before leading and after
    trailing white space, and as the only part of an empty text. The parts are a column of
    their own, as an expression used several times would be evaluated as often.
    """
    cut = frame.withColumn("__parts", F.split(F.coalesce(text, F.lit("")), spaces))
    parts = F.col("__parts")
    first = F.when(F.get(parts, 0) == "", 2).otherwise(1)
    last = F.when((F.size(parts) > 1) & (F.get(parts, F.size(parts) - 1) == ""), 1).otherwise(0)
    words = F.slice(parts, first, F.greatest(F.size(parts) - first + 1 - last, F.lit(0)))
    return cut.withColumn(name, words).drop("__parts")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, UPPER.lower())


def in_fold(doc_id: Column, parts: int, fold: int) -> Column:
    """Whether the row is of that fold; a null id is of none."""
    return F.coalesce(remainder(doc_id, parts) == fold, F.lit(False))


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`: the fold of a row. Null stays null."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))
