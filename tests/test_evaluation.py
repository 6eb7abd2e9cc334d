import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from countloom.functions import distributions as dist
from countloom.operators import rolling, scoring
from countloom.plans import features, folds, models, studies
from countloom.plans.side_by_side import side_by_side

from .test_studies import contests


def indexed(spark, n=240):
    return rolling.chronological_index(contests(spark, n)).persist()


def test_no_date_is_on_both_sides(spark):
    df = indexed(spark).withColumn("date", F.date_trunc("week", "date").cast("date")).persist()
    bounds = folds.date_bounds(df, models.fold_bounds(240))
    assert len(bounds) == 5 and bounds[-1][1] == 240
    for (lo, hi), (raw, _) in zip(bounds, models.fold_bounds(240), strict=True):
        assert lo <= raw
        folds.guard(df.where(F.col("idx") < lo), df.where((F.col("idx") >= lo) & (F.col("idx") < hi)))
    with pytest.raises(ValueError, match="begins"):
        folds.guard(df.where("idx < 121"), df.where("idx >= 121").unionByName(df.where("idx = 100")))
    with pytest.raises(ValueError, match="empty"):
        folds.guard(df.where("idx < 0"), df)


def test_phases(spark):
    rows = [(i, 2020 + i // 10, f"2020-01-{1 + i:02d}", "P" if i % 10 in (6, 8) else "R") for i in range(20)]
    g = spark.createDataFrame(rows, "game_pk long, season int, date string, game_type string").withColumn("date", F.to_date("date"))
    train, test = folds.phase_split(g, "P", "2021")
    assert sorted(r.game_pk for r in train.collect()) == list(range(16)) and sorted(r.game_pk for r in test.collect()) == [16, 18]
    got = {r.game_pk: (r.is_train, r.is_test) for r in folds.phase_cutoffs(g, "P").collect()}
    assert got[5] == (True, False) and got[7] == (False, False) and got[8] == (False, True) and got[15] == (True, False)
    assert sorted(r.game_pk for r in features.cohort(g, ["2021"], ["P"]).collect()) == [16, 18]


def test_fold_report_against_numpy(spark):
    rng = np.random.default_rng(2)
    mu, y = rng.uniform(3, 7, 300), rng.poisson(5, 300)
    df = spark.createDataFrame([(i, int(y[i]), float(mu[i])) for i in range(300)], "idx long, y int, mu double")
    bounds = [(100, 160), (160, 300)]
    got = {(r.fold, r.threshold): r for r in folds.fold_report(df, bounds, (4.5, 6.5)).collect()}
    assert len(got) == 6
    p = np.array([[math.exp(k * math.log(m) - m - math.lgamma(k + 1)) for k in range(21)] for m in mu])
    p /= p.sum(axis=1, keepdims=True)
    for fold, (lo, hi) in enumerate(bounds):
        r, s = got[fold, None], slice(lo, hi)
        cdf = p[s].cumsum(axis=1)
        crps = ((cdf - (np.arange(21)[None] >= y[s, None])) ** 2).sum(axis=1)
        n_cal = int(0.2 * lo)
        e = np.sort(np.abs(y - mu)[lo - n_cal : lo])
        assert (r.n_test, r.n_train, r.n_cal, r.brier, r.base_rate) == (hi - lo, lo, n_cal, None, None)
        assert (r.mae, r.crps, r.conformal_q) == (pytest.approx(np.abs(y - mu)[s].mean()), pytest.approx(crps.mean()), pytest.approx(e[math.ceil(0.9 * (n_cal - 1))]))
        for t in (4.5, 6.5):
            over = (y[s] > t).astype(float)
            q = p[s][:, int(t) + 1 :].sum(axis=1)
            assert got[fold, t].brier == pytest.approx(((q - over) ** 2).mean()) and got[fold, t].mae is None
            assert got[fold, t].base_rate == pytest.approx((y[:lo] > t).mean())
    summary = {(r.threshold, r.metric): r for r in folds.over_folds(folds.fold_report(df, bounds, (4.5, 6.5))).collect()}
    both = [got[f, None].mae for f in (0, 1)]
    assert summary[None, "mae"].mean == pytest.approx(np.mean(both)) and summary[None, "mae"].deviation == pytest.approx(np.std(both))


def test_halving_keeps_the_better_third(spark):
    df = indexed(spark)
    space = {"depth": (1, 3, "int"), "rate": (0.01, 0.3, "log"), "trees": (9, 18, "int"), "columns": (0.5, 1.0, "float"), "leaf": (1, 5, "int")}
    got = studies.halving_search(df, ["strong", "idle"], [(120, 180), (180, 240)], space, trials=6, at_once=4).collect()
    assert sorted(r["round"] for r in got) == [1] * 4 + [2, 3][1:] + [2] or sorted(r["round"] for r in got) == [1, 1, 1, 1, 2, 3]
    best = min(got, key=lambda r: r["rank"])
    assert best["round"] == 3 and all(space[k][0] <= v <= space[k][1] for r in got for k, v in r.params.items())
    first = [r for r in got if r["round"] == 1]
    assert sorted(r["rank"] for r in got) == list(range(1, 7)) and [r["rank"] for r in sorted(first, key=lambda r: r.mae)] == [3, 4, 5, 6]


def test_importance_of_each_season(spark):
    df = contests(spark).withColumn("total_goals", F.when(F.col("season") == 2021, F.col("idle") * 10).otherwise(F.col("total_goals")))
    got = {(r.season, r.feature): r.importance for r in studies.importance_by_season(df, ["strong", "idle"], trees=5, depth=2).collect()}
    assert got[2020, "strong"] > 0.55 and got[2021, "idle"] > 0.65 and abs(got[2020, "strong"] + got[2020, "idle"] - 1) < 1e-9


def test_jobs_side_by_side(spark):
    assert side_by_side(spark, [lambda k=k: spark.range(k).count() for k in range(5)], 3) == list(range(5))
    with pytest.raises(ZeroDivisionError):
        side_by_side(spark, [lambda: 1, lambda: 1 / 0])


def test_champions(spark):
    scored = spark.createDataFrame([("poisson_glm", 1.2, 2.0, 1.0), ("boosted_trees", 0.9, 1.8, 1.0), ("team_strength", 1.0, 1.9, 1.0)], "model string, score double, mae double, crps double")
    ranked = scoring.rank_candidates(scored)
    test = lambda significant: spark.createDataFrame([("team_strength", significant)], "model_b string, significant boolean")
    assert tuple(scoring.pairwise_champion(ranked, test(False)).first()) == ("team_strength", "boosted_trees", True)
    assert tuple(scoring.pairwise_champion(ranked, test(True)).first()) == ("boosted_trees", "boosted_trees", False)
    assert tuple(scoring.pairwise_champion(ranked, test(False).limit(0)).first()) == ("boosted_trees", "boosted_trees", False)
    assert {r.model for r in scoring.rank_candidates(scored, without=("poisson_glm",)).collect()} == {"boosted_trees", "team_strength"}


def test_decisions(spark):
    rows = [(0.6, 1, 0.5, "w1"), (0.4, 1, 0.5, "w2"), (0.52, 0, 0.5, "w3"), (0.5, 1, 0.5, "w1"), (0.7, 1, 0.4, "w2")]
    df = spark.createDataFrame(rows, "p_over double, y_over int, reference_p_over double, block_key string")
    got = {(r.strategy, r.min_edge): r for r in scoring.decision_report(df, [0.01, 0.05], n_boot=500).collect()}
    low = got["model", 0.01]
    assert (low.bets, low.wins, low.pnl) == (4, 2, pytest.approx(1 - 1 - 1 + 1.5)) and low.ci_low <= low.roi <= low.ci_high
    assert got["model", 0.05].bets == 3 and got["reference", 0.0].bets == 0
    # A draw's return is that of the weeks drawn: the interval's ends lie between the worst and the best week.
    assert -1 <= low.ci_low and low.ci_high <= 1
    for bad in ((1.2, 1, 0.5, "w"), (0.5, 1, 1.0, "w"), (None, 1, 0.5, "w")):
        with pytest.raises(Exception, match="forecast lies"):
            scoring.flat_stakes(spark.createDataFrame([bad], df.schema), [0.0]).collect()
    with pytest.raises(ValueError):
        scoring.flat_stakes(df, [-0.1])


def test_randomized_pit_is_uniform_for_a_right_forecast(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, int(k)) for i, k in enumerate(rng.poisson(4.0, 5000))], "key long, y int").withColumn("pmf", dist.poisson_pmf(F.lit(4.0), 30))
    u = np.sort([r[0] for r in df.select(dist.randomized_pit(F.col("pmf"), F.col("y"), F.col("key"))).collect()])
    assert np.abs(u - (np.arange(5000) + 0.5) / 5000).max() < 0.025  # Kolmogorov's distance
    again = df.repartition(7).select(F.sum(dist.randomized_pit(F.col("pmf"), F.col("y"), F.col("key")))).first()[0]
    assert again == pytest.approx(u.sum())


def test_diagnostics_and_baseline(spark):
    games = spark.createDataFrame([(1, "2024-01-05", 2024, "a", "b", 1, 0, 1.0, 3.0), (2, None, 2024, "a", "b", 0, 0, None, 3.0)], "game_pk long, date string, season int, home_team string, away_team string, home_is_back_to_back int, away_is_back_to_back int, home_rest_days double, away_rest_days double").withColumn("date", F.to_date("date"))
    scores = spark.createDataFrame([(1, 0, 5, 6.5, 0.4), (2, 1, 5, 4.0, 0.3)], "game_pk long, fold int, y int, mu double, p_over double")
    got = {r.game_pk: r for r in scoring.diagnostics(scores, games).collect()}
    assert (got[1].abs_error, got[1].squared_error, got[1].is_back_to_back, got[1].back_to_back, got[1].month, got[1].rest_diff_bucket) == (1.5, 2.25, 1, "yes", 1, "away_rested")
    assert (got[2].back_to_back, got[2].month, got[2].rest_diff_bucket) == ("no", -1, "unknown")
    r = scoring.point_metrics(scores, train=spark.createDataFrame([(3,), (4,)], "y int")).first()
    assert (r.baseline_mae, r.mae, r.improvement_pct) == (1.5, 1.25, pytest.approx(100 / 6))
    with pytest.raises(ValueError, match="no feature"):
        features.require_features(games.select("game_pk"))


def test_poisson_regression_solves_its_equations(spark):
    """Without a penalty the fitted means add up to the counts, overall and weighted by each feature."""
    df, cols = contests(spark), ["strong", "idle"]
    out = models.fit_pipeline("poisson_glm", df, cols, alpha=0.0).transform(df)
    sums = out.agg(*[F.sum(F.col(c) * (F.col("mu") - F.col("total_goals"))) for c in cols], F.sum(F.col("mu") - F.col("total_goals")), F.sum("total_goals")).first()
    assert all(abs(s) < 1e-3 * sums[3] for s in sums[:3])
