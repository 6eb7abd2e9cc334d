"""Tables kept in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where the session has no such folder (one machine), a new temporary one is set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of that name, in whatever storage."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


#: Rows of a task after a shuffle of wide rows: the contests with all features take about 150 bytes each there.
TASK_ROWS = 250_000


def tasks_for(spark: SparkSession, rows: int, size: int | None = None) -> int | None:
    """The number of tasks of about size rows (TASK_ROWS), or None where the session's shuffle partitions are as many."""
    n = -(-rows // (size or TASK_ROWS))
    return n if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def by_rows(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df, which has that many rows, shuffled by the keys into tasks that do not grow with it; as it is where a shuffle makes enough.

    What groups, joins or ranks by these keys next needs no other shuffle.
    """
    n = tasks_for(df.sparkSession, rows)
    return df.repartition(n, *keys) if n else df


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table below spark.checkpoint.dir, read back: later plans begin at its scan."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
