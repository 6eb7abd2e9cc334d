from pyspark.sql import functions as F

from countloom.operators import rolling
from countloom.plans import models, studies

SCHEMA = "game_pk long, season int, date string, home_team string, away_team string, home_score int, away_score int, total_goals int, strong double, idle double"


def contests(spark, n=240):
    import random

    rng, rows = random.Random(7), []
    for i in range(n):
        strong, idle = rng.random() * 4, rng.random()
        x, y = int(strong) + rng.randrange(2), rng.randrange(3)
        rows.append((i, 2020 + i // 120, f"{2020 + i // 120}-{1 + i % 120 // 28:02d}-{1 + i % 28:02d}", f"T{i % 6}", f"T{(i + 1 + i % 5) % 6}", x, y, x + y, strong, idle))
    return spark.createDataFrame(rows, SCHEMA).withColumn("date", F.to_date("date")).repartition(3).persist()


def test_importance_ablation_and_search(spark):
    df, cols = rolling.chronological_index(contests(spark)).persist(), ["strong", "idle"]
    bounds = [(180, 240)]
    predict = models.fit_point_model("ridge", df, cols)
    got = {r.feature: r.importance for r in studies.permutation_importance(predict, df.drop("idx"), cols, repeats=2).collect()}
    assert got["strong"] > 0.3 > abs(got["idle"])
    a = {r.scenario: r for r in studies.ablation(df, "ridge", cols, bounds, {"without_strong": "^strong$", "without_idle": "^idle$"}).collect()}
    assert a["full"].delta_mae == 0 and a["without_strong"].features == 1 and a["without_strong"].delta_mae > a["without_idle"].delta_mae
    s = studies.random_search(df, "ridge", cols, bounds, {"alpha": (0.1, 10.0, "log")}, trials=2).collect()
    assert sorted(r["rank"] for r in s) == [1, 2] and all(0.1 <= r.params["alpha"] <= 10 for r in s)


def test_stack_is_no_worse_than_the_mean(spark):
    df, cols = contests(spark), ["strong", "idle"]
    out = studies.fit_stack(df, cols, ("ridge", "poisson_glm"), folds=2)(df)
    assert set(out.columns) == {*df.columns, "mu"}
    err, mean_err = out.agg(F.avg(F.abs(F.col("mu") - F.col("total_goals"))), F.avg(F.abs(F.col("total_goals") - df.agg(F.avg("total_goals")).first()[0]))).first()
    assert err < 0.8 * mean_err


def test_team_strength_is_fitted_on_pairs(spark):
    """The fit reads pairs of teams and counts, and gives the coefficients of the fit on all contests."""
    from pyspark.ml import Pipeline
    from pyspark.ml.regression import GeneralizedLinearRegression

    df = contests(spark)
    made = models.team_strength(df)
    whole = GeneralizedLinearRegression(family="poisson", link="log", labelCol="total_goals", regParam=1.0 / df.agg(F.avg("total_goals")).first()[0], featuresCol="x", predictionCol="mu")
    whole = Pipeline(stages=[*made.stages[:3], whole]).fit(df)
    mu = lambda m: [r.mu for r in m.transform(df).orderBy("game_pk").select("mu").collect()]
    assert max(abs(a - b) for a, b in zip(mu(made), mu(whole), strict=True)) < 1e-7
    assert made.stages[-1].summary.numInstances < df.count()


def test_mixture_fit(spark):
    wide = spark.createDataFrame([(y, 4.0) for y in (0, 1, 1, 2, 2, 8, 9, 9, 10, 12)] * 4, "y int, mu double")
    weight, multiplier = models.fit_mixture(wide)
    assert 0.1 <= weight <= 0.9 and multiplier > 1.5


def test_locked_benchmark_refuses_wrong_totals(spark):
    import pytest

    df = rolling.chronological_index(contests(spark)).withColumn("total_goals", F.col("total_goals") + (F.col("game_pk") == 3).cast("int"))
    with pytest.raises(ValueError, match="1 totals differ"):
        studies.locked_benchmark(df, ["strong"])


def test_linear_importance_is_that_of_the_model(spark):
    """Sums of products give MLlib's ridge regression, and its permutation importance without running it."""
    from countloom.plans import linear

    df = contests(spark).withColumn("same", F.lit(2.0))
    cols = ["strong", "idle", "same"]
    line = linear.products(df, cols).ridge([0], cols)
    predict = models.fit_point_model("ridge", df, cols)
    off = predict(df).agg(F.max(F.abs(F.col("mu") - F.greatest(line.raw(), F.lit(1e-9))))).first()[0]
    assert off < 1e-7
    rows = lambda found: {r.feature: (r.importance, r.deviation) for r in found.collect()}
    a, b = rows(studies.permutation_importance(predict, df, cols, repeats=3)), rows(studies.linear_importance(line, df, cols, repeats=3))
    assert a.keys() == b.keys() and all(abs(x - y) < 1e-7 for f in cols for x, y in zip(a[f], b[f], strict=True))


def test_ridge_ablation_is_that_of_single_fits(spark, monkeypatch):
    """All scenarios and folds from one table of sums score as evaluate does fold by fold, and fit no ridge."""
    df, cols = rolling.chronological_index(contests(spark, 480)).persist(), ["strong", "idle"]
    bounds, families = [(240, 360), (360, 480)], {"without_strong": "^strong$"}
    names = ("mae", "crps", "dist_nll", "over_brier")
    want = {k: models.fold_metrics(models.evaluate(df, "ridge", kept, bounds)).agg(*[F.avg(c).alias(c) for c in names]).first() for k, kept in (("full", cols), ("without_strong", ["idle"]))}
    fitted = models.fit_point_model
    monkeypatch.setattr(models, "fit_point_model", lambda kind, *a, **k: fitted(kind, *a, **k) if kind != "ridge" else 1 / 0)
    got = {r.scenario: r for r in studies.ablation(df, "ridge", cols, bounds, families).collect()}
    assert [*got] == ["full", "without_strong", "team_strength"]
    assert all(abs(got[k][c] - want[k][c]) < 1e-9 for k in want for c in names)


def test_search_keeps_its_folds_in_memory(spark, monkeypatch):
    """The fits of a search read a fold's vectors from memory, largest fits first, and nothing stays there."""
    df, seen, fitted = rolling.chronological_index(contests(spark)), [], models.fit_on_vectors

    def fit(kind, train, **params):
        seen.append((train.storageLevel.useMemory, params["trees"] * params["depth"]))
        return fitted(kind, train, **params)

    monkeypatch.setattr(models, "fit_on_vectors", fit)
    space = {"depth": (1, 3, "int"), "trees": (9, 40, "int")}
    before = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    studies.halving_search(df, ["strong", "idle"], [(180, 240)], space, trials=3, at_once=1)
    assert all(kept for kept, _ in seen) and len(seen) == 5
    drawn = studies.draw_trials(space, 3)
    assert [work for _, work in seen[:3]] == [max(1, round(p["trees"] / 9)) * p["depth"] for p in sorted(drawn, key=lambda p: -p["trees"] * p["depth"])]
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == before
