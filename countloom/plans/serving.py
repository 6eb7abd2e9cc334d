"""Forecasts of contests to come, from the history before them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import distributions as dist
from ..operators import tables
from ..sources.shared import written
from . import artifact
from . import features as feat

Predict = Callable[[DataFrame], DataFrame]


def with_history(upcoming: DataFrame, history: DataFrame) -> DataFrame:
    """History and slate as one table; the slate's results are masked, and an id in both counts as history."""
    slate = tables.mask_upcoming(upcoming)
    return tables.history_first(history.withColumn("_is_upcoming", F.lit(False)), slate)


def predict_games(predict: Predict, upcoming: DataFrame, history: DataFrame, features: list[str], fills: dict[str, float], windows: tuple[int, ...] = feat.WINDOWS) -> DataFrame:
    """mu for each upcoming contest: features from the history, missing ones by the training medians (0 where there is none)."""
    every = feat.add_features(with_history(upcoming, history), windows=windows)
    slate = tables.fill_from(every.where("_is_upcoming"), fills, feat.resolve_features(every, features))
    return predict(slate)


def serve(model: artifact.Artifact, upcoming: DataFrame, history: DataFrame, thresholds: tuple[float, ...] = (5.5, 6.5, 7.5), windows: tuple[int, ...] = feat.WINDOWS, max_count: int = 20) -> DataFrame:
    """A saved model's forecasts of the upcoming contests, ready for the ledger.

    game_pk, date, home_team, away_team, artifact_id, feature_schema_hash,
    mu, pmf (NB2, with the dispersion of the history's last fifth), the chance
    to exceed each threshold, interval and band, and features: the values
    that the model read, by name.
    """
    every = written(feat.add_features(with_history(upcoming, history), windows=windows), "served")
    alpha, radius = artifact.calibrate(model, every.where("NOT _is_upcoming"))
    names = model.metadata.features
    slate = model.predict(every.where("_is_upcoming"))
    read = F.create_map(*[x for c in names for x in (F.lit(c), F.col(c).cast("double"))]) if names else F.lit(None).cast("map<string,double>")
    slate = slate.select("game_pk", "date", "home_team", "away_team", F.lit(model.metadata.artifact_id).alias("artifact_id"), F.lit(model.metadata.feature_schema_hash).alias("feature_schema_hash"), "mu", read.alias("features"))
    band = upcoming.sparkSession.createDataFrame([(radius,)], "radius double")
    return probabilistic(slate, dist.nb2_pmf(F.col("mu"), alpha, max_count), band, thresholds)


def probabilistic(df: DataFrame, pmf: Column, radius: DataFrame, thresholds: tuple[float, ...] = (5.5, 6.5, 7.5)) -> DataFrame:
    """df (with mu) and its pmf, the chance to exceed each threshold, the 80 % interval and the conformal band.

    radius is one row with the column radius, from the calibration rows.
    """
    out = df.withColumn("pmf", pmf)
    p = F.col("pmf")
    over = {f"p_over_{str(t).replace('.', '_')}": dist.prob_over(p, t) for t in thresholds}
    ends = {"pi_low": dist.quantile(p, 0.1 - 1e-12), "pi_high": dist.quantile(p, 0.9 - 1e-12)}
    banded = out.withColumns({**over, **ends}).crossJoin(F.broadcast(radius.select("radius")))  # one row
    return banded.withColumns({"conformal_low": F.greatest(F.col("mu") - F.col("radius"), F.lit(0.0)), "conformal_high": F.col("mu") + F.col("radius")})
