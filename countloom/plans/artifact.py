"""A fitted model with all that serving and monitoring need, saved and loaded whole.

On disk an artifact is a folder of the shared storage: the MLlib pipeline, the
drift references as a Parquet table, and the metadata as one JSON line. The
metadata is written last, so a folder without it is one whose writing broke
off, and loading it is an error.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift, scoring, tables
from ..sources.shared import written
from . import linear, models, studies

#: Name of the forecasts among the references.
FORECAST = "predicted_total_goals"
#: Models that read the contest table itself and no features.
GAME_FRAME = ("team_strength", "double_poisson")


def schema_hash(features: list[str]) -> str:
    """A digest of the features' names in order."""
    return hashlib.sha256(json.dumps(list(features), separators=(",", ":")).encode()).hexdigest()


@dataclass
class Metadata:
    kind: str
    features: list[str]
    fills: dict[str, float]
    artifact_id: str
    feature_schema_hash: str
    data_fingerprint: str
    rows: int
    first_date: str
    last_date: str
    parameters: dict[str, float] = field(default_factory=dict)
    metrics: dict[str, float] = field(default_factory=dict)


@dataclass
class Artifact:
    model: PipelineModel
    metadata: Metadata
    references: DataFrame

    def predict(self, df: DataFrame) -> DataFrame:
        """df with mu; a feature that is missing or null is the training rows' median, or 0 without one."""
        for c in self.metadata.features:
            if c not in df.columns:
                df = df.withColumn(c, F.lit(None).cast("double"))
        return self.model.transform(tables.fill_from(df, self.metadata.fills, self.metadata.features))

    def save(self, path: str) -> None:
        """Write the artifact into a new folder."""
        spark = self.references.sparkSession
        self.model.save(f"{path}/model")
        self.references.write.parquet(f"{path}/references")
        spark.createDataFrame([(json.dumps(asdict(self.metadata)),)], "value string").coalesce(1).write.text(f"{path}/metadata")


def load(spark: SparkSession, path: str) -> Artifact:
    """The artifact of a folder; its features must be those whose digest it has."""
    metadata = Metadata(**json.loads(spark.read.text(f"{path}/metadata").first()["value"]))
    if schema_hash(metadata.features) != metadata.feature_schema_hash:
        raise ValueError(f"the features of {path} are not those of its schema")
    return Artifact(PipelineModel.load(f"{path}/model"), metadata, spark.read.schema(drift.REFERENCE).parquet(f"{path}/references"))


def release(df: DataFrame, kind: str, features: list[str], metrics: dict[str, float] | None = None, target: str = "total_goals", **parameters) -> Artifact:
    """The model of a kind fitted on all rows of df, with medians, drift references of its forecasts and features, and the cohort's digest."""
    used = [] if kind in GAME_FRAME else list(features)
    if kind == "stacked":
        model = studies.fit_stack_pipeline(df, used, target=target, **parameters)
    elif kind == "ridge":
        line = linear.products(df, used, target=target).ridge([0], used, **parameters)
        model = PipelineModel(stages=[SQLTransformer(statement=f"SELECT *, greatest({line.sql()}, 1e-9D) AS mu FROM __THIS__")])
    else:
        model = models.fit_pipeline(kind, df, used, target, **parameters)
    seen = model.transform(df).select(F.col("mu").alias(FORECAST), *used)
    references, medians = drift.references_and_medians(seen, [FORECAST, *used])
    references, fills = written(references, "references"), {c: medians[c] for c in used if c in medians}
    print_of = tables.fingerprint(df, ["game_pk", "date", "home_team", "away_team", target]).first()[0]
    n, first, last = df.agg(F.count("*"), F.min("date").cast("string"), F.max("date").cast("string")).first()
    name = f"{kind}-{print_of[:12]}"
    return Artifact(model, Metadata(kind, used, fills, name, schema_hash(used), print_of, n, first, last, dict(parameters), dict(metrics or {})), references)


def calibrate(artifact: Artifact, history: DataFrame, fraction: float = 0.2, q: float = 0.9, target: str = "total_goals") -> tuple[float, float | None]:
    """NB2 dispersion and conformal radius of the artifact's forecasts on the last rows of the history that have all features and a result."""
    complete = history.na.drop(subset=[*artifact.metadata.features, target])
    placed = models.indexed(complete.select("game_pk", "date"))  # the features are not sorted with their rows
    n = placed.count()
    if not n:
        raise ValueError("no row of the history has all features and a result")
    last = placed.where(F.col("idx") >= n - max(1, int(fraction * n))).select(F.col("game_pk").alias("__id"), F.col("date").alias("__day"))
    last = complete.join(last, F.col("game_pk").eqNullSafe(F.col("__id")) & F.col("date").eqNullSafe(F.col("__day")), "left_semi")
    held = written(artifact.predict(last).select(F.col(target).alias("y"), "mu"), "calibration")
    radius = scoring.higher_quantile(held.select(F.abs(F.col("y") - F.col("mu")).alias("e")), "e", q).first()["radius"]
    return models.fit_alpha(held), radius
