"""Positions of rows in an order over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.shared import tasks_for, written


def number_rows(df: DataFrame, order: list[str], out: str = "idx", nulls_first: bool = False) -> DataFrame:
    """df with each row's position (from 0) in the order of the columns given, nulls last or first; a column named as out is replaced.

    The rows are sorted by range over all tasks and counted by partition, so
    no task sees more than its range. Rows equal in all columns rank by
    their place in df, which splits them too, however many they are; only the
    counts, one a partition, meet in one place.
    """
    kept = [c for c in df.columns if c != out]
    given = written(df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")), "rows").withColumn("tie", F.monotonically_increasing_id())
    fields = [F.col("row").getField(c) for c in order]
    by = [*[c.asc_nulls_first() if nulls_first else c.asc_nulls_last() for c in fields], F.col("tie")]
    n = tasks_for(df.sparkSession, given.count())  # from the files' footers
    ranged = (given.repartitionByRange(n, *by) if n else given.repartitionByRange(*by)).sortWithinPartitions(*by).select("row", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    ranged = written(ranged, "ranged")
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(counts.select("part", before.alias("start")))  # a row for each shuffle partition
    return ranged.join(starts, "part").select(*[F.col("row").getField(c).alias(c) for c in kept], (F.col("start") + F.col("at")).alias(out))
