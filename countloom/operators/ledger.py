"""The ledger of forecasts, and what became of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distributions as dist
from ..sources.shared import exists, written
from . import drift, tables

KEY = ["game_pk", "artifact_id", "forecast_kind"]
#: Columns whose old value stays when a later write has none.
KEEP_OLD = ["pmf", "thresholds", "features"]
#: Rows of the newest forecasts that a summary looks at.
RECENT = 200


def append(batch: DataFrame, batch_id: int, path: str) -> None:
    """foreachBatch sink: batch_id orders the writes, and a batch written again replaces itself."""
    batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def load(log: DataFrame, artifact_id: str | None = None) -> DataFrame:
    """The ledger's rows as of its last writes, in order of predicted_at and game_pk.

    log is what append wrote, read back, or what writes gives. The last write
    of a key counts, whatever its predicted_at; columns of KEEP_OLD fall back
    to the last value that is not null.
    """
    out = tables.latest_ledger(log, KEY, _kept(log), ["batch_id"]).drop("batch_id")
    return (out.where(F.col("artifact_id") == artifact_id) if artifact_id else out).orderBy("predicted_at", "game_pk")


def _kept(df: DataFrame) -> list[str]:
    return [c for c in KEEP_OLD if c in df.columns]


def held_by(spark: SparkSession, snapshots: str) -> int:
    """The last batch that the newest complete snapshot holds, -1 without one."""
    if not exists(spark, f"{snapshots}/commits"):
        return -1
    return spark.read.schema("version long").parquet(f"{snapshots}/commits/*").agg(F.max("version")).first()[0]


def writes(spark: SparkSession, path: str, snapshots: str) -> DataFrame:
    """The newest snapshot's rows, with the batch that wrote each last, and the batches after it; others are not read."""
    version = held_by(spark, snapshots)
    later = spark.read.parquet(path).withColumn("batch_id", F.col("batch_id").cast("long")).where(F.col("batch_id") > version)
    if version < 0:
        return later
    return spark.read.parquet(f"{snapshots}/data/version={version}").unionByName(later, allowMissingColumns=True)


def compact(spark: SparkSession, path: str, snapshots: str, buckets: int = 64) -> int:
    """Merge the batches since the last snapshot into a new one, by buckets of the key; the last batch that it holds.

    The commit is written after the snapshot: a compaction that breaks off
    leaves files that nobody reads, and the next one writes over them. A
    batch that is written again after a snapshot holds it changes nothing.
    Once a snapshot is committed, the batches that it holds may be deleted.
    """
    given = writes(spark, path, snapshots)
    last = given.agg(F.max("batch_id")).first()[0]
    if last is None or last <= held_by(spark, snapshots):
        return held_by(spark, snapshots)
    merged = tables.latest_ledger(given, KEY, _kept(given), ["batch_id"])
    merged.repartition(buckets, *KEY).sortWithinPartitions(*KEY).write.mode("overwrite").parquet(f"{snapshots}/data/version={last}")
    spark.createDataFrame([(last,)], "version long").coalesce(1).write.mode("overwrite").parquet(f"{snapshots}/commits/{last}")
    return last


def realized_metrics(reconciled: DataFrame, max_count: int = 20) -> DataFrame:
    """One row: n, crps, nll, mid_pit_mean and the rate of mid-PITs below 0.1 or above 0.9, over rows with pmf and actual."""
    held = reconciled.where("actual IS NOT NULL AND pmf IS NOT NULL")
    y = F.col("actual").cast("int")
    rows = held.select(dist.crps(F.col("pmf"), y).alias("crps"), dist.pmf_nll(F.col("pmf"), y).alias("nll"), dist.mid_pit(F.col("pmf"), y).alias("pit"))
    return rows.agg(
        F.count("*").alias("n"), F.avg("crps").alias("crps"), F.avg("nll").alias("nll"), F.avg("pit").alias("mid_pit_mean"), F.avg(((F.col("pit") < 0.1) | (F.col("pit") > 0.9)).cast("int")).alias("mid_pit_tail_rate")
    )


def recent_rows(logged: DataFrame, n: int = RECENT) -> DataFrame:
    """The n newest forecasts: a top-k by predicted_at and game_pk."""
    return logged.orderBy(F.desc("predicted_at"), F.desc("game_pk")).limit(n)


def monitoring_summary(logged: DataFrame, results: DataFrame, reference: DataFrame | None = None, n: int = RECENT, forecast: str = "predicted_total_goals") -> DataFrame:
    """One row: n_logged, n_reconciled, the realised metrics of the n newest forecasts, and the drift of the forecasts.

    reference has the references of an artifact (see drift.references), the
    forecasts' under the name given, or else the column mu of the forecasts
    that the model was accepted with; without it drift is null and its status
    unavailable. The drift of the features is feature_drift's.
    """
    reconciled = tables.reconcile(logged, results)
    counts = reconciled.agg(F.count("*").alias("n_logged"), F.count("actual").alias("n_reconciled"))
    recent = written(recent_rows(reconciled, n), "recent")
    out = counts.crossJoin(F.broadcast(realized_metrics(recent)))  # one row each
    if reference is None:
        return out.withColumns({"psi": F.lit(None).cast("double"), "status": F.lit("unavailable")})
    if "fractions" not in reference.columns:
        reference = written(drift.references(reference.select(F.col("mu").alias(forecast)), [forecast]), "references")
    of = drift.stability(recent.select(F.lit(forecast).alias("name"), F.col("mu").alias("x")), reference.where(F.col("name") == forecast))
    return out.crossJoin(F.broadcast(of.select("psi", "status")))


def feature_drift(logged: DataFrame, references: DataFrame, n: int = RECENT, forecast: str = "predicted_total_goals") -> DataFrame:
    """A row for each reference: how the n newest forecasts, and the features that they were made from (a map by name), differ from it."""
    recent = recent_rows(logged, n)
    values = recent.select(F.explode(F.map_concat(F.coalesce("features", F.create_map().cast("map<string,double>")), F.create_map(F.lit(forecast), F.col("mu")))).alias("name", "x"))
    return drift.stability(values, references)
