"""Tables that grow by loads, with a manifest of what has been taken in.

A store is a folder of the shared storage. Each load writes its rows below
data/load=N, by season, and then one file of manifest rows: the source files
that it read and the seasons that it brought. The manifest is the commit. A
load that broke off has none; its rows are not read, and the next one takes
the same number and writes over them. Taking in the same files again does
nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import exists, written

MANIFEST = "load long, kind string, name string, modified timestamp, length long, n long"


def manifest(spark: SparkSession, store: str) -> DataFrame:
    """What has been taken in: a row for each source file and for each season of a load."""
    if not exists(spark, f"{store}/manifest"):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{store}/manifest/*")


def last_load(spark: SparkSession, store: str) -> int:
    """The number of the last committed load, 0 before the first."""
    return manifest(spark, store).agg(F.max("load")).first()[0] or 0


def source_files(spark: SparkSession, source: str) -> DataFrame:
    """name, modified, length of the files of a folder; their content is not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source).select(F.col("path").alias("name"), F.col("modificationTime").alias("modified"), "length")


def new_files(spark: SparkSession, source: str, store: str) -> DataFrame:
    """The source's files that no load has read as they are now."""
    taken = manifest(spark, store).where("kind = 'file'").select("name", "modified", "length")
    return source_files(spark, source).join(taken, ["name", "modified", "length"], "left_anti")


def commit(rows: DataFrame, store: str, files: DataFrame | None = None, by: str = "season") -> int:
    """Write the rows as the next load and enter it in the manifest; its number."""
    spark = rows.sparkSession
    load = last_load(spark, store) + 1
    rows.withColumn("__by", F.col(by).cast("string")).write.mode("overwrite").partitionBy("__by").parquet(f"{store}/data/load={load}")
    told = read_load(spark, store, load, rows).groupBy("__by").agg(F.count("*").alias("n"))
    entries = told.select(F.lit(load).cast("long").alias("load"), F.lit("season").alias("kind"), F.col("__by").alias("name"), F.lit(None).cast("timestamp").alias("modified"), F.lit(None).cast("long").alias("length"), "n")
    if files is not None:
        entries = entries.unionByName(files.select(F.lit(load).cast("long").alias("load"), F.lit("file").alias("kind"), "name", "modified", "length", F.lit(None).cast("long").alias("n")))
    entries.coalesce(1).write.mode("overwrite").parquet(f"{store}/manifest/load={load}")
    return load


def read_load(spark: SparkSession, store: str, load: int, like: DataFrame) -> DataFrame:
    """The rows of one load, with their season as text in __by."""
    return spark.read.schema(like.schema.add("__by", "string")).option("basePath", f"{store}/data/load={load}").parquet(f"{store}/data/load={load}")


def read(spark: SparkSession, store: str, key: list[str], seasons: list[str] | None = None) -> DataFrame:
    """The committed rows, the newest load's of each key; only the asked seasons' folders are read.

    A store without loads is an error, as it has no columns.
    """
    last = last_load(spark, store)
    if not last:
        raise ValueError(f"nothing has been taken in at {store}")
    rows = spark.read.parquet(f"{store}/data").where(F.col("load") <= last)
    if seasons is not None:
        rows = rows.where(F.col("__by").cast("string").isin([str(s) for s in seasons]))
    columns = [c for c in rows.columns if c not in ("load", "__by")]
    newest = rows.groupBy(*[F.col(k).alias(f"__{k}") for k in key]).agg(F.max_by(F.struct(*columns), "load").alias("row"))
    return newest.select("row.*")


def take_in(spark: SparkSession, source: str, store: str, parse: Callable[[list[str]], DataFrame], by: str = "season") -> int:
    """Parse the source's new files and commit them as one load; the number of files, 0 if none is new.

    Only the names of the new files come to the driver, as in any Spark reader.
    """
    fresh = written(new_files(spark, source, store), "new-files")
    names = [r["name"] for r in fresh.select("name").collect()]
    if names:
        commit(parse(names), store, fresh, by)
    return len(names)


def load_seasons(spark: SparkSession, store: str, key: list[str], seasons: list[str], bulk: Callable[[], DataFrame], by: str = "season") -> DataFrame:
    """The seasons' rows; those that the store lacks are taken from the bulk table first, in one load, and kept.

    bulk is called only if a season is missing. Seasons are codes such as
    20232024, or their first year.
    """
    codes = [s if len(s) == 8 else f"{s}{int(s) + 1}" for s in map(str, seasons)]
    have = {r["name"] for r in manifest(spark, store).where((F.col("kind") == "season") & F.col("name").isin(codes)).select("name").distinct().collect()}
    if missing := [c for c in codes if c not in have]:
        found = written(bulk().where(F.col(by).isin(missing)), "bulk")
        if not found.isEmpty():
            commit(found, store, by=by)
        elif not last_load(spark, store):
            return found
    return read(spark, store, key, codes)


def not_stored(new: DataFrame, stored: DataFrame, key: str = "game_pk") -> DataFrame:
    """Rows whose id is not stored yet."""
    return new.join(stored.select(key), key, "left_anti")


def append_new(new: DataFrame, store: str, key: str = "game_pk", by: str = "season") -> DataFrame:
    """Commit the rows of new whose id the store lacks, and give all that it has then."""
    spark = new.sparkSession
    fresh = new if not last_load(spark, store) else not_stored(new, read(spark, store, [key]), key)
    fresh = written(fresh, "fresh")
    if not fresh.isEmpty():
        commit(fresh, store, by=by)
    return read(spark, store, [key])
