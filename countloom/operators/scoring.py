"""Scores, calibration, drift, decisions and request metrics as grouped aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalars
from ..sources.shared import written
from . import drift, order_stats, resample

#: The parts of the combined model score.
WEIGHTS = {"mae": 0.35, "crps": 0.30, "dist_nll": 0.20, "over_brier": 0.15}
#: The same parts by contest, and the models from simple to complex.
PER_GAME = {"mae": "abs_error", "crps": "crps", "dist_nll": "dist_nll", "over_brier": "over_brier"}
COMPLEXITY = ("team_strength", "poisson_glm", "double_poisson", "boosted_trees", "tuned_boosted_trees")


def point_metrics(df: DataFrame, y: str = "y", mu: str = "mu", by: list[str] | None = None, train: DataFrame | None = None) -> DataFrame:
    """n, mae, rmse, bias and r; with the training rows also baseline_mae, of their mean, and the improvement on it in percent."""
    e = F.col(mu) - F.col(y)
    if train is not None:
        mean = F.broadcast(train.agg(F.avg(y).alias("__mean")))  # one row
        out = df.crossJoin(mean).groupBy(*(by or [])).agg(F.avg(F.abs(F.col(y) - F.col("__mean"))).alias("baseline_mae"), *_points(e, y, mu))
        return out.withColumn("improvement_pct", 100 * (1 - F.col("mae") / F.col("baseline_mae")))
    return df.groupBy(*(by or [])).agg(*_points(e, y, mu))


def correlation(a: str, b: str) -> Column:
    """Pearson's r; null where one of both does not vary."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def _points(e: Column, y: str, mu: str) -> list[Column]:
    return [F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), correlation(mu, y).alias("r")]


def brier(p: Column, y: Column) -> Column:
    return F.avg(F.pow(p - y, F.lit(2)))


def log_loss(p: Column, y: Column, eps: float = 1e-12) -> Column:
    c = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return -F.avg(y * F.ln(c) + (1 - y) * F.ln(1 - c))


def reliability(df: DataFrame, p: str = "p", y: str = "y", bins: int = 10) -> DataFrame:
    """Mean forecast and outcome by equal bins, half-open but for the last; empty bins are left out.

    Edges are the floating-point numbers i * (1 / bins), as a linear spacing gives them.
    """
    edges = [i * (1.0 / bins) for i in range(1, bins)]
    b = sum((F.when(F.col(p) >= e, 1).otherwise(0) for e in edges), F.lit(0))
    return df.groupBy(b.alias("bin")).agg(F.avg(p).alias("mean_p"), F.avg(y).alias("mean_y"), F.count("*").alias("n"))


def segments(df: DataFrame, columns: list[str]) -> DataFrame:
    """Error tables of several segmentations in one pass."""
    long = df.select("mu", "y", F.explode(F.array(*[F.struct(F.lit(c).alias("segment"), F.col(c).cast("string").alias("value")) for c in columns])).alias("s")).select("mu", "y", "s.*")
    e = F.col("mu") - F.col("y")
    return long.groupBy("segment", "value").agg(F.count("*").alias("games"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg("mu").alias("avg_mu"), F.avg("y").alias("avg_y"))


def histogram_reference(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """One row: n and the inner edges of the column's quantile bins; a single bin where all values are the same."""
    return drift.references(df, [column], bins).select("n", "inner")


def psi(reference: DataFrame, recent: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """One row: psi of recent rows against the reference rows' quantile bins, the number of bins, and the status."""
    return drift.stability(drift.long_of(recent, [column]), written(drift.references(reference, [column], bins), "references")).select("psi", "bins", "status")


def model_edge(p: Column, reference: Column) -> Column:
    """Forecast less reference; an error where either is no probability, or the reference is certain."""
    wrong = F.raise_error(F.lit("a forecast lies in [0, 1] and its reference in (0, 1)")).cast("double")
    return F.when((p < 0) | (p > 1) | (reference <= 0) | (reference >= 1) | p.isNull() | reference.isNull(), wrong).otherwise(p - reference)


def decision_report(df: DataFrame, min_edges: list[float], p: str = "p_over", y: str = "y_over", ref: str = "reference_p_over", block: str = "block_key", n_boot: int = 5000) -> DataFrame:
    """flat_stakes by cut-off with the interval of the return over blocks, and the control that stakes by the reference itself.

    strategy is `model`, or `reference` for the control, which finds no edge and stakes nothing.
    """
    cut = F.explode(F.array(*[F.lit(float(e)) for e in min_edges])).alias("min_edge")
    edge = model_edge(F.col(p), F.col(ref))
    rows = written(df.select(F.col(block).alias("block"), F.col(y).alias("y"), F.col(ref).alias("ref"), edge.alias("edge"), cut), "bets")
    won = F.when(F.col("edge") > 0, F.col("y") == 1).otherwise(F.col("y") == 0)
    price = F.when(F.col("edge") > 0, F.col("ref")).otherwise(1 - F.col("ref"))
    takes = (F.abs("edge") >= F.col("min_edge")) & (F.col("edge") != 0)
    pnl = F.when(takes, F.when(won, 1 / price - 1).otherwise(-1.0)).otherwise(0.0)
    blocks = written(rows.groupBy("min_edge", "block").agg(F.sum(pnl).alias("total"), F.count_if(takes).alias("n")), "bet-blocks")
    drawn = resample.drawn_ratios(blocks, "min_edge", n_boot)
    ends = drawn.groupBy(F.col("min_edge").alias("of")).agg(F.percentile("ratio", F.lit(0.025)).alias("ci_low"), F.percentile("ratio", F.lit(0.975)).alias("ci_high"))  # a value a draw
    stakes = flat_stakes(df, min_edges, p, y, ref)
    model = stakes.join(ends, F.col("min_edge") == F.col("of")).drop("of").withColumn("strategy", F.lit("model"))
    control = df.agg(F.lit(0.0).alias("min_edge"), F.count_if(F.col(ref) != F.col(ref)).alias("bets")).withColumn("strategy", F.lit("reference"))
    return model.unionByName(control, allowMissingColumns=True)


def diagnostics(scores: DataFrame, games: DataFrame) -> DataFrame:
    """A row for each scored contest: what its error can be set against.

    scores has game_pk, fold, y, mu and p_over; games the teams, date, season
    and, where known, the sides' rest days and back-to-back flags.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int") if c in games.columns else F.lit(0)
    rest = F.col("home_rest_days") - F.col("away_rest_days") if "home_rest_days" in games.columns else F.lit(None).cast("double")
    known = games.select("game_pk", "date", F.col("season").cast("string").alias("season"), "home_team", "away_team", flag("home_is_back_to_back").alias("home_is_back_to_back"), flag("away_is_back_to_back").alias("away_is_back_to_back"), scalars.rest_bucket(rest.cast("double")).alias("rest_diff_bucket"))
    e = F.col("mu") - F.col("y")
    out = scores.select("game_pk", "fold", F.col("y").alias("y_true"), F.col("mu").alias("mu_pred"), "p_over", F.abs(e).alias("abs_error"), (e * e).alias("squared_error")).join(known, "game_pk")
    either = F.greatest("home_is_back_to_back", "away_is_back_to_back")
    return out.withColumns({"is_back_to_back": either, "back_to_back": F.when(either == 1, "yes").otherwise("no"), "month": F.coalesce(F.month("date"), F.lit(-1))})


def flat_stakes(df: DataFrame, min_edges: list[float], p: str = "p_over", y: str = "y_over", ref: str = "reference_p_over", stake: float = 1.0) -> DataFrame:
    """Bets, wins, profit and mean directed edge of staking where the model is away from the reference, by cut-off."""
    if any(e < 0 for e in min_edges) or stake <= 0:
        raise ValueError("edges are not below and stakes above zero")
    edge = model_edge(F.col(p), F.col(ref))
    bets = df.select("*", F.explode(F.array(*[F.lit(e) for e in min_edges])).alias("min_edge"), edge.alias("edge")).where(F.abs("edge") >= F.col("min_edge")).where("edge <> 0")
    won = F.when(F.col("edge") > 0, F.col(y) == 1).otherwise(F.col(y) == 0)
    price = F.when(F.col("edge") > 0, F.col(ref)).otherwise(1 - F.col(ref))
    bets = bets.withColumn("pnl", F.when(won, stake * (1 / price - 1)).otherwise(-stake)).withColumn("won", won.cast("int"))
    return bets.groupBy("min_edge").agg(
        F.count("*").alias("bets"), F.sum("won").alias("wins"), F.avg("won").alias("hit_rate"), F.sum("pnl").alias("pnl"), (F.sum("pnl") / (F.count("*") * stake)).alias("roi"), F.avg(F.abs("edge")).alias("mean_edge")
    )


def weighted_score(metrics: DataFrame, baseline_name: str) -> DataFrame:
    """score: the weighted sum of each metric over the baseline's."""
    metrics = written(metrics, "metrics")  # a row a model; both sides of the join need it
    base = metrics.where(F.col("model") == baseline_name).select(*[F.col(c).alias("b_" + c) for c in WEIGHTS])
    score = sum(w * F.col(c) / F.greatest(F.col("b_" + c), F.lit(1e-9)) for c, w in WEIGHTS.items())
    return metrics.crossJoin(F.broadcast(base)).withColumn("score", score).drop(*["b_" + c for c in WEIGHTS])  # base: one row


def per_game_scores(scores: DataFrame, baseline_name: str) -> DataFrame:
    """The same by contest; its mean is the model's score."""
    base = scores.where(F.col("model") == baseline_name).agg(*[F.avg(c).alias("b_" + k) for k, c in PER_GAME.items()])
    score = sum(w * F.col(PER_GAME[k]) / F.greatest(F.col("b_" + k), F.lit(1e-9)) for k, w in WEIGHTS.items())
    return scores.crossJoin(F.broadcast(base)).withColumn("score", score).drop(*["b_" + k for k in PER_GAME])  # base: one row


def rank_candidates(scored: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """rank by score, MAE, CRPS; the table has a row for each model, but those left out."""
    if without:
        scored = scored.where(~F.col("model").isin(*without))
    return scored.withColumn("rank", F.row_number().over(W.orderBy("score", "mae", "crps")))


def complexity(model: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(m) for m in COMPLEXITY]), model), F.lit(len(COMPLEXITY) + 1))


def equivalence_champion(ranked: DataFrame, comparisons: DataFrame) -> DataFrame:
    """The simplest of the leader and the models that are not significantly worse."""
    same = ranked.join(comparisons.select(F.col("model_b").alias("model"), "significant"), "model", "left").where((F.col("rank") == 1) | ~F.col("significant"))
    return same.agg(F.min_by("model", F.struct(complexity(F.col("model")), "score", "mae")).alias("champion"), F.count("*").alias("equivalent"))


def pairwise_champion(ranked: DataFrame, comparison: DataFrame) -> DataFrame:
    """champion, leader and demoted: the leader, or the second if that is simpler and the leader not significantly better.

    comparison has a row for the second (model_b) with significant; without one, or with one model, the leader stays.
    """
    pair = ranked.where("rank <= 2").join(comparison.select(F.col("model_b").alias("model"), "significant"), "model", "left")
    top = pair.agg(*[F.max(F.when(F.col("rank") == r, F.col(c))).alias(f"{c}_{r}") for r in (1, 2) for c in ("model", "significant")])
    demoted = F.coalesce(~F.col("significant_2") & (complexity(F.col("model_2")) < complexity(F.col("model_1"))), F.lit(False))
    return top.select(F.when(demoted, F.col("model_2")).otherwise(F.col("model_1")).alias("champion"), F.col("model_1").alias("leader"), demoted.alias("demoted"))


def holm(tests: DataFrame, p: str = "p") -> DataFrame:
    """Holm's adjusted p values; one row a test, so a window over all of them is small."""
    w = W.orderBy(p, "idx")
    stepped = tests.withColumn("__m", F.count("*").over(W.partitionBy(F.lit(1)))).withColumn("__rn", F.row_number().over(w))
    raw = F.least(F.lit(1.0), F.col(p) * (F.col("__m") - F.col("__rn") + 1))
    return stepped.withColumn("p_holm", F.max(raw).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("__m", "__rn")


def request_metrics(log: DataFrame, recent: int = 1024) -> DataFrame:
    """Requests, errors and mean latency by route, with nearest-rank percentiles of the newest samples of each."""
    rank = F.row_number().over(W.partitionBy("r").orderBy(F.desc("ts"), F.desc("id")))
    # A filter on the rank, so that each task keeps its newest of a route before rows move.
    newest = log.select(F.col("route").alias("r"), "ts", "id", "latency_ms").withColumn("rn", rank).where(F.col("rn") <= recent)
    pct = {f"p{int(q * 100)}": F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY latency_ms)") for q in (0.5, 0.95, 0.99)}
    tails = newest.groupBy("r").agg(*[c.alias(k) for k, c in pct.items()])
    every = log.groupBy("route").agg(F.count("*").alias("requests"), F.count_if(F.col("status") >= 500).alias("errors"), F.avg("latency_ms").alias("mean_latency"))
    return every.join(tails, F.col("route").eqNullSafe(F.col("r"))).drop("r").withColumn("error_rate", F.col("errors") / F.col("requests"))


def higher_quantile(df: DataFrame, score: str, q: float) -> DataFrame:
    """One row, n and radius: element ceil(q * (n - 1)) of the sorted scores; null without any."""
    n, values = order_stats.select(written(df.select(score), "scores"), {score: [q]}, interpolate=False).get(("", score), (0, [None]))
    return df.sparkSession.createDataFrame([(n, values[0])], "n long, radius double")
