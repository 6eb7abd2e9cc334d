import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from countloom.operators import drift, ledger
from countloom.plans import artifact, models, serving, studies

from .test_studies import contests

PSI = lambda p, q: sum((max(a, 1e-6) - max(b, 1e-6)) * math.log(max(a, 1e-6) / max(b, 1e-6)) for a, b in zip(p, q, strict=True))


def test_references_and_drift_against_numpy(spark):
    rng = np.random.default_rng(3)
    old = {"a": rng.normal(size=500), "few": rng.integers(0, 3, 500) * 1.0, "same": np.full(500, 2.0), "gaps": np.where(rng.random(500) < 0.5, np.nan, rng.random(500)), "none": np.full(500, np.nan)}
    new = {"a": rng.normal(0.7, 1.2, 300), "few": rng.integers(0, 4, 300) * 1.0, "same": np.full(300, 2.5), "gaps": rng.random(300), "none": rng.random(300)}
    frame = lambda d: spark.createDataFrame([tuple(None if x != x else float(x) for x in r) for r in zip(*d.values(), strict=True)], ", ".join(f"{c} double" for c in d))
    refs = drift.references(frame(old), list(old))
    got = {r.name: r for r in drift.stability(drift.long_of(frame(new), list(new)), refs).collect()}
    for c in ("a", "few", "same", "gaps"):
        x = old[c][np.isfinite(old[c])]
        inner = np.unique(np.quantile(x, np.arange(11) / 10))[1:-1]
        part = lambda v: np.bincount(np.searchsorted(inner, v, "right"), minlength=len(inner) + 1) / len(v)  # noqa: B023, E731
        assert got[c].psi == pytest.approx(PSI(part(new[c]), part(x)), abs=1e-12), c
        assert (got[c].n_reference, got[c].n_recent, got[c].bins) == (len(x), 300, len(inner) + 1)
    assert got["a"].status == "significant" and got["same"].status == "stable" and got["none"].status == "unavailable"
    few = {r.name: r for r in drift.stability(drift.long_of(frame(new).limit(1), ["a"]), refs).collect()}
    assert few["a"].status == few["few"].status == "unavailable" and few["few"].n_recent == 0


@pytest.mark.parametrize("kind", ["ridge", "poisson_glm", "boosted_trees", "random_forest", "team_strength", "double_poisson", "stacked"])
def test_a_saved_model_is_the_same_in_another_session(spark, tmp_path, kind):
    df, cols = contests(spark), ["strong", "idle"]
    small = {"boosted_trees": {"trees": 3}, "random_forest": {"trees": 3, "depth": 3}, "stacked": {"kinds": ("ridge", "poisson_glm"), "folds": 2}}.get(kind, {})
    made = artifact.release(df, kind, cols, {"mae": 1.0}, **small)
    made.save(f"{tmp_path}/a")
    other = spark.newSession()
    held = artifact.load(other, f"{tmp_path}/a")
    assert held.metadata.artifact_id == made.metadata.artifact_id and held.metadata.metrics == {"mae": 1.0} and held.metadata.rows == 240
    want = {r.game_pk: r.mu for r in made.predict(df).collect()}
    df.write.parquet(f"{tmp_path}/df")
    again = held.predict(other.read.parquet(f"{tmp_path}/df"))
    assert {r.game_pk: r.mu for r in again.collect()} == want
    assert set(again.columns) >= {*df.columns, "mu"} and not {"x", "z_strong", "hi"} & set(again.columns)
    assert sorted(map(str, held.references.collect())) == sorted(map(str, made.references.collect()))
    names = {r.name for r in held.references.collect()}
    assert names == {artifact.FORECAST} | (set() if kind in artifact.GAME_FRAME else set(cols))


def test_pipelines_predict_as_before(spark):
    """The ridge against its closed form: standardised features, penalty alpha, no penalty on the mean."""
    df, cols = contests(spark), ["strong", "idle"]
    rows = df.toPandas()
    x = (rows[cols] - rows[cols].mean()) / rows[cols].std(ddof=0)
    y = rows.total_goals - rows.total_goals.mean()
    w = np.linalg.solve(x.T @ x + 2.0 * np.eye(2), x.T @ y)
    got = {r.game_pk: r.mu for r in models.fit_pipeline("ridge", df, cols, alpha=2.0).transform(df).collect()}
    for pk, mu in zip(rows.game_pk, x.to_numpy() @ w + rows.total_goals.mean(), strict=True):
        assert got[pk] == pytest.approx(max(mu, 1e-9), abs=1e-6)


def test_a_folder_without_metadata_is_refused(spark, tmp_path):
    made = artifact.release(contests(spark), "ridge", ["strong"])
    made.model.save(f"{tmp_path}/a/model")
    with pytest.raises(Exception, match="metadata"):
        artifact.load(spark, f"{tmp_path}/a")
    made.metadata.feature_schema_hash = "other"
    made.save(f"{tmp_path}/b")
    with pytest.raises(ValueError, match="schema"):
        artifact.load(spark, f"{tmp_path}/b")


def test_serving_logs_what_the_model_read(spark):
    g = contests(spark).drop("strong", "idle").withColumn("game_type", F.lit("R"))
    cols = ["home_avg_total", "away_avg_total", "combined_avg_total"]
    from countloom.plans import features

    df = features.complete_cases(features.add_features(g.where("game_pk < 200"), windows=(5,)), cols)
    made = artifact.release(df, "ridge", [*cols, "not_there_when_serving"][:3])
    out = serving.serve(made, g.where("game_pk >= 200"), g.where("game_pk < 200"), windows=(5,)).persist()
    assert out.count() == 40 and out.agg(F.count("total_goals")).first()[0] == 0 if "total_goals" in out.columns else True
    r = out.first()
    assert set(r.features) == set(cols) and r.artifact_id == made.metadata.artifact_id and abs(sum(r.pmf) - 1) < 1e-9
    assert r.conformal_low <= r.mu <= r.conformal_high and 0 <= r.p_over_7_5 <= r.p_over_5_5 <= 1
    seen = {r.name: r for r in ledger.feature_drift(out.withColumn("predicted_at", F.col("date")), made.references).collect()}
    assert set(seen) == {artifact.FORECAST, *cols} and all(x.n_recent == 40 and x.psi >= 0 for x in seen.values())
    assert studies.top_features(spark.createDataFrame([(0, "a", 1.0)], "season int, feature string, importance double"), 1).count() == 1


def test_a_release_reads_quantiles_once(spark, monkeypatch):
    """The medians come from the passes of the references, and are those of the columns by themselves."""
    from countloom.operators import drift, order_stats, tables

    df = spark.range(101).select((F.col("id") * F.col("id") % 37).cast("double").alias("a"), F.when(F.col("id") % 3 > 0, F.col("id") / 7).alias("b"), F.lit(None).cast("double").alias("c"))
    want, calls, select = tables.medians(df, ["a", "b", "c"]).first().asDict(), [], order_stats.select
    monkeypatch.setattr(order_stats, "select", lambda *a, **k: calls.append(1) or select(*a, **k))
    refs, medians = drift.references_and_medians(df, ["a", "b", "c"])
    assert medians == {k: v for k, v in want.items() if v is not None} and calls == [1]
    assert sorted(map(str, refs.collect())) == sorted(map(str, drift.references(df, ["a", "b", "c"]).collect()))


def test_a_ridge_is_released_from_sums_of_products(spark, monkeypatch):
    """No vectors and no MLlib fit, and MLlib's forecasts."""
    from countloom.plans import artifact, models
    from tests.test_studies import contests

    df, cols = contests(spark), ["strong", "idle"]
    want = [r.mu for r in models.fit_point_model("ridge", df, cols)(df).orderBy("game_pk").select("mu").collect()]
    monkeypatch.setattr(models, "estimator", lambda *a, **k: 1 / 0)
    got = [r.mu for r in artifact.release(df, "ridge", cols, alpha=1.0).predict(df).orderBy("game_pk").select("mu").collect()]
    assert max(abs(a - b) for a, b in zip(want, got, strict=True)) < 1e-7
