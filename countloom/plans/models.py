"""Count models over feature tables, by MLlib."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distributions as dist
from ..operators import rolling, scoring
from ..sources.shared import written
from . import boost, folds


def _mean(df: DataFrame, target: str) -> float:
    return df.agg(F.avg(target)).first()[0]


def team_strength(train: DataFrame, target: str = "total_goals", alpha: float = 1.0) -> PipelineModel:
    """Poisson regression on home and away team; a team not seen in training has no effect.

    The penalty is per mean of the target, because the fit weighs rows by their means. Contests of the same teams and
    count are one row with their number as weight, so the fit's passes are over pairs and counts and not over contests.
    """
    cells = written(train.groupBy("home_team", "away_team", target).agg(F.count("*").cast("double").alias("__n")), "cells")
    mean = cells.where(F.col(target).isNotNull()).agg(F.sum(F.col(target) * F.col("__n")) / F.sum("__n")).first()[0]
    index = StringIndexer(inputCols=["home_team", "away_team"], outputCols=["hi", "ai"], handleInvalid="keep")
    hot = OneHotEncoder(inputCols=["hi", "ai"], outputCols=["hv", "av"], dropLast=True)
    glm = GeneralizedLinearRegression(family="poisson", link="log", labelCol=target, weightCol="__n", regParam=alpha / mean, featuresCol="x", predictionCol="mu")
    return Pipeline(stages=[index, hot, VectorAssembler(inputCols=["hv", "av"], outputCol="x"), glm]).fit(cells)


def double_poisson(train: DataFrame, alpha: float = 1.0) -> PipelineModel:
    """One regression for each side's count (lambda_home, lambda_away); the total's mean is their sum."""
    stages = []
    for side in ("home", "away"):
        stages += [team_strength(train, f"{side}_score", alpha), SQLTransformer(statement=f"SELECT * EXCEPT (hi, ai, hv, av, x, mu), mu AS lambda_{side} FROM __THIS__")]
    return PipelineModel(stages=[*stages, SQLTransformer(statement="SELECT *, greatest(lambda_home + lambda_away, 1e-9D) AS mu FROM __THIS__")])


def _scaled(train: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    row = train.agg(*[F.avg(c).alias("m" + c) for c in features], *[F.stddev_pop(c).alias("s" + c) for c in features]).first()
    return {c: (row["m" + c], row["s" + c] or 1.0) for c in features}


def _at_least(*drop: str) -> SQLTransformer:
    """The last stage of a model: mu is 1e-9 at least, and the columns it was made with go."""
    return SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join(f'`{c}`' for c in (*drop, 'mu'))}), greatest(mu, 1e-9D) AS mu FROM __THIS__")


def fit_pipeline(kind: str, train: DataFrame, features: list[str], target: str = "total_goals", seed: int = 42, **params) -> PipelineModel:
    """A model of one of the kinds that adds mu (1e-9 at least) to a table; it can be saved and loaded whole."""
    if kind == "team_strength":
        return PipelineModel(stages=[team_strength(train, target, params.get("alpha", 1.0)), _at_least("hi", "ai", "hv", "av", "x")])
    if kind == "double_poisson":
        return double_poisson(train, params.get("alpha", 1.0))
    if kind == "boosted_trees":
        return PipelineModel(stages=[boost.fit(train, features, target, **params), _at_least()])
    stages = vector_stages(kind, train, features)
    made = PipelineModel(stages=stages).transform(train)
    drop = [c for c in made.columns if c not in train.columns]
    return PipelineModel(stages=[*stages, estimator(kind, made, target, seed, **params).fit(made), _at_least(*drop)])


def fit_point_model(kind: str, train: DataFrame, features: list[str], target: str = "total_goals", seed: int = 42, **params) -> Callable[[DataFrame], DataFrame]:
    """As fit_pipeline: the function that adds mu."""
    return fit_pipeline(kind, train, features, target, seed, **params).transform


def vector_stages(kind: str, train: DataFrame, features: list[str]) -> list:
    """The stages that add x, the features as a vector; for linear models scaled by the training rows' means and deviations."""
    scale = _scaled(train, features) if kind in ("poisson_glm", "ridge") else {}
    if not scale:
        return [VectorAssembler(inputCols=features, outputCol="x")]
    number = lambda v: f"CAST('{v!r}' AS DOUBLE)"
    scaled = ", ".join(f"(`{c}` - {number(m)}) / {number(s)} AS `z_{c}`" for c, (m, s) in scale.items())
    return [SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__"), VectorAssembler(inputCols=["z_" + c for c in features], outputCol="x")]


def estimator(kind: str, train: DataFrame, target: str = "total_goals", seed: int = 42, **params):
    """The MLlib estimator of a kind, for tables with x."""
    common = {"labelCol": target, "featuresCol": "x", "predictionCol": "mu"}
    if kind == "poisson_glm":
        return GeneralizedLinearRegression(family="poisson", link="log", regParam=params.get("alpha", 1.0) / _mean(train, target), **common)
    if kind == "ridge":
        n, sd = train.agg(F.count("*"), F.stddev_pop(target)).first()
        return LinearRegression(regParam=params.get("alpha", 1.0) * sd / n, standardization=False, solver="normal", **common)
    if kind == "random_forest":
        return RandomForestRegressor(numTrees=params.get("trees", 200), maxDepth=params.get("depth", 12), featureSubsetStrategy="all", maxMemoryInMB=512, seed=seed, **common)
    if kind == "boosted_trees":
        return GBTRegressor(
            maxIter=params.get("trees", 50), maxDepth=params.get("depth", 4), stepSize=params.get("rate", 0.05), subsamplingRate=params.get("subsample", 0.8),
            featureSubsetStrategy=str(params.get("columns", "all")), minInstancesPerNode=params.get("leaf", 1), minInfoGain=params.get("gain", 0.0), seed=seed, **common,
        )
    raise ValueError(kind)


def vectors(kind: str, train: DataFrame, features: list[str]) -> Callable[[DataFrame], DataFrame]:
    """A function that adds x (see vector_stages)."""
    stages = PipelineModel(stages=vector_stages(kind, train, features))
    return lambda df: stages.transform(df).select(*df.columns, "x")


def fit_on_vectors(kind: str, train: DataFrame, target: str = "total_goals", seed: int = 42, **params) -> Callable[[DataFrame], DataFrame]:
    """As fit_point_model, for tables with x, which the function drops."""
    model = estimator(kind, train, target, seed, **params).fit(train)
    return lambda df: model.transform(df).withColumn("mu", F.greatest(F.col("mu"), F.lit(1e-9))).drop("x")


def fit_alphas(cal: DataFrame, by: list[str], y: str = "y", mu: str = "mu") -> DataFrame:
    """alpha for each value of the columns by: the NB2 dispersion with the least mean negative log likelihood over {0} and 50 logarithmic steps."""
    grid = [0.0] + [10 ** (-4 + 4.7 * i / 49) for i in range(50)]
    # Each row meets the 51 grid points; counts repeat, so rows are grouped by (y, rounded mu) first. The groups are few bytes, but much work.
    cells = cal.groupBy(*by, F.col(y).cast("int").alias("y"), F.round(mu, 4).alias("mu")).agg(F.count("*").alias("n")).repartition(cal.sparkSession.sparkContext.defaultParallelism)
    points = cells.select(*by, "y", "mu", "n", F.posexplode(F.array(*[F.lit(a) for a in grid])).alias("i", "alpha"))
    # What a mean adds to the likelihood at mean 1 is a few logarithms; the rest depends on the count alone and is taken once for each.
    a, k, m = F.col("alpha"), F.col("y"), F.greatest(F.col("mu"), F.lit(dist.FLOOR))
    beyond = k * F.ln(m) - F.when(a > 0, (k + 1 / F.when(a > 0, a)) * (F.log1p(a * m) - F.log1p(a))).otherwise(m - 1)
    counts = points.groupBy(*by, "i", "alpha", "y").agg(F.sum(F.col("n") * beyond).alias("beyond"), F.sum("n").alias("n"))
    nll = counts.groupBy(*by, "i", "alpha").agg((-F.sum(F.col("beyond") + F.col("n") * dist.nb2_logpmf(k, F.lit(1.0), a)) / F.sum("n")).alias("nll"))
    return nll.groupBy(*by).agg(F.min_by("alpha", F.struct("nll", "i")).alias("alpha"))


def fit_alpha(cal: DataFrame, y: str = "y", mu: str = "mu") -> float:
    """As fit_alphas, of all rows."""
    return fit_alphas(cal, [], y, mu).first()[0]


#: Nine weights and sixteen multipliers for the mixture.
MIXTURE_WEIGHTS = [i / 10 for i in range(1, 10)]
MIXTURE_MULTIPLIERS = [1.05 + 0.05 * i for i in range(16)]


def mixture_losses(cal: DataFrame, weights: list[float], multipliers: list[float], max_count: int = 20) -> DataFrame:
    """weight, multiplier and mean negative log likelihood of the two-part Poisson mixture at each grid point.

    Counts repeat, so rows are grouped by (y, rounded mu) first.
    """
    cells = cal.groupBy(F.col("y").cast("int").alias("y"), F.round("mu", 4).alias("mu")).agg(F.count("*").alias("n"))
    held = cells.select("*", F.explode(F.array(*[F.lit(float(m)) for m in multipliers])).alias("multiplier"))
    at = lambda mu: F.element_at(dist.poisson_pmf(mu, max_count), F.least(F.col("y"), F.lit(max_count)) + 1)
    held = held.withColumns({"a": at(F.col("mu") * F.col("multiplier")), "b": at(F.col("mu") / F.col("multiplier"))})
    points = held.select("*", F.explode(F.array(*[F.lit(float(w)) for w in weights])).alias("weight"))
    p = F.greatest(F.col("weight") * F.col("a") + (1 - F.col("weight")) * F.col("b"), F.lit(1e-12))
    return points.groupBy("weight", "multiplier").agg((-F.sum(F.col("n") * F.ln(p)) / F.sum("n")).alias("nll"))


def fit_mixture(cal: DataFrame) -> tuple[float, float]:
    """Weight and multiplier with the least loss; the first in the grid's order among equals."""
    losses = mixture_losses(cal, MIXTURE_WEIGHTS, MIXTURE_MULTIPLIERS)
    return tuple(losses.agg(F.min_by(F.struct("weight", "multiplier"), F.struct("nll", "weight", "multiplier"))).first()[0])


def score_rows(df: DataFrame, alpha: float, threshold: float = 6.5, max_count: int = 20) -> DataFrame:
    """abs_error, crps, dist_nll, p_over, y_over, over_brier and mid_pit for rows with y and mu."""
    out = df.withColumn("pmf", dist.nb2_pmf(F.col("mu"), alpha, max_count))
    out = out.withColumns({"p_over": dist.prob_over(F.col("pmf"), threshold), "y_over": (F.col("y") > threshold).cast("int")})
    y = F.col("y").cast("int")
    return out.withColumns({
        "abs_error": F.abs(F.col("y") - F.col("mu")), "crps": dist.crps(F.col("pmf"), y, max_count), "dist_nll": dist.pmf_nll(F.col("pmf"), y),
        "over_brier": F.pow(F.col("p_over") - F.col("y_over"), F.lit(2)), "mid_pit": dist.mid_pit(F.col("pmf"), y),
    })


def fold_bounds(n: int, parts: int = 5) -> list[tuple[int, int]]:
    """First and last index (exclusive) of each test fold; training is all before."""
    t = n // (parts + 1)
    return [(n - (parts - i) * t, n - (parts - i - 1) * t) for i in range(parts)]


def evaluate(df: DataFrame, kind: str, features: list[str], bounds: list[tuple[int, int]], cal_fraction: float = 0.2, threshold: float = 6.5, **params) -> DataFrame:
    """Per-contest scores of a model over chronological folds; df has idx and the target total_goals.

    In each fold the last cal_fraction of the training rows calibrate the dispersion. Folds and calibration begin with a
    date, so that none is on both sides; a fold where one is would be an error.
    """
    out = None
    bounds = folds.date_bounds(df, bounds)
    for fold, (lo, hi) in enumerate(bounds):
        n_cal = max(1, int(min(max(cal_fraction, 0.05), 0.5) * lo))
        from_cal = folds.at_dates(df, [lo - n_cal])[0]
        fit, cal = df.where(F.col("idx") < from_cal), df.where((F.col("idx") >= from_cal) & (F.col("idx") < lo))
        folds.guard(fit, cal)
        folds.guard(cal, df.where((F.col("idx") >= lo) & (F.col("idx") < hi)))
        predict = fit_point_model(kind, fit, features, **params)
        named = lambda d: predict(d).withColumn("y", F.col("total_goals"))  # noqa: B023, E731
        alpha = fit_alpha(named(cal))
        test = score_rows(named(df.where((F.col("idx") >= lo) & (F.col("idx") < hi))), alpha, threshold)
        test = test.select("game_pk", "date", F.lit(kind).alias("model"), F.lit(fold).alias("fold"), "mu", "y", "abs_error", "crps", "dist_nll", "p_over", "y_over", "over_brier", "mid_pit")
        out = test if out is None else out.unionByName(test)
    return out


def fold_metrics(scores: DataFrame) -> DataFrame:
    return scores.groupBy("model", "fold").agg(
        F.count("*").alias("n_test"), F.avg("abs_error").alias("mae"), F.sqrt(F.avg(F.pow("abs_error", F.lit(2)))).alias("rmse"),
        F.avg("crps").alias("crps"), F.avg("dist_nll").alias("dist_nll"), F.avg("over_brier").alias("over_brier"), scoring.log_loss(F.col("p_over"), F.col("y_over")).alias("over_log_loss"),
    )


def indexed(df: DataFrame) -> DataFrame:
    return rolling.chronological_index(df)
