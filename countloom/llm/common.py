"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: White space of the word rule [^\x20\x09-\x0D]+, without the plain space.
OTHER_SPACE = "\t\n\x0b\f\r"

#: A key with this part of all rows or more is hot.
HOT_PARTS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where a session on one machine (tests) has none, a new folder below the
    temporary one is set for the session. On a cluster executors would each
    write to a disk of their own, so that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: The rows of whole texts that a Python task gets at once.
TEXTS_AT_ONCE = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialize(df: DataFrame, tag: str = "table", batch: int | None = None) -> DataFrame:
    """Write df once as a Parquet table in the shared folder and read it back.

    Cuts the lineage: what follows survives lost executors without running
    the work above again, and Spark knows the size of what it joins with.
    With batch, Python tasks of this write get at most so many rows at once
    (the session's setting is put back), as a batch is held by both the JVM
    and the worker.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    usual = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, usual if batch is None else str(batch))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_BATCH, usual)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that materialize wrote, once nothing needs it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def join_counted(left: DataFrame, right: DataFrame, left_key: str, right_key: str, n: str, total: int) -> DataFrame:
    """Inner join with a table of distinct keys that knows (column n) how many of the total rows of left have each key.

    Keys of a thousandth of all rows or more, so a thousand at most, are
    broadcast; no task gets more than the rows of a rarer key.
    """
    few = max(1, total // HOT_PARTS)
    hot, rest = F.broadcast(right.where(F.col(n) >= few)), right.where(F.col(n) < few)
    on = F.col(left_key) == F.col(right_key)
    cold = left.join(hot.select(F.col(right_key)), on, "left_anti").join(rest, on)
    return left.join(hot, on).unionByName(cold)


def spark_partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text, in order; null counts as empty."""
    spaced = F.translate(F.coalesce(text, F.lit("")), OTHER_SPACE, " " * len(OTHER_SPACE))
    return F.array_remove(F.split(spaced, " ", -1), "")


def text_crc32(text: Column) -> Column:
    """CRC-32 of the UTF-8 bytes, unsigned; null counts as empty."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
