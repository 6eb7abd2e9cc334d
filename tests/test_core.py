import math

import pytest
from pyspark.sql import functions as F

from countloom.functions import distributions as dist
from countloom.functions import scalars
from countloom.operators import resample, rolling, scoring, tables
from countloom.plans import features, models
from countloom.sources import games as src
from countloom.streaming import live

GAMES = "game_pk long, season int, date string, home_team string, away_team string, home_score int, away_score int, total_goals int"


def some_games(spark, rows):
    return spark.createDataFrame(rows, GAMES).withColumn("date", F.to_date("date"))


def history(spark):
    rows = [(1, 2025, "2025-10-01", "A", "B", 3, 2, 5), (2, 2025, "2025-10-03", "A", "C", 4, 1, 5), (3, 2025, "2025-10-05", "A", "B", None, None, None), (4, 2025, "2025-10-07", "A", "C", None, None, None)]
    return some_games(spark, rows)


def league(spark, n=160, change=None):
    import random

    rng = random.Random(42)
    teams = [f"T{i}" for i in range(8)]
    rows = []
    for i in range(n):
        h, a = rng.sample(teams, 2)
        x, y = rng.randrange(6), rng.randrange(6)
        if i == change:
            x += 7
        rows.append((2024020000 + i, 2024, f"2024-{10 + i // 62:02d}-{1 + i // 2 % 30:02d}", h, a, x, y, x + y))
    return some_games(spark, rows)


def test_scheduled_rows_do_not_pollute_history(spark):
    out = features.add_features(history(spark), window=5, min_games=1).where("game_pk = 4").first()
    assert (out.home_avg_gf, out.home_win_pct, out.home_win_streak, out.home_games_played) == (3.5, 1.0, 2, 2)


def test_no_feature_sees_its_own_or_a_later_result(spark):
    cols = features.feature_columns()
    assert len(cols) == 79
    at = 80
    read = lambda g: {r.game_pk: tuple(r)[1:] for r in features.add_features(g, min_games=1).select("game_pk", *cols).collect()}
    a, b = read(league(spark)), read(league(spark, change=at).repartition(7))
    day = {r.game_pk: r.date for r in league(spark).select("game_pk", "date").collect()}
    changed = {k for k in a if a[k] != b[k]}
    cut = (day[2024020000 + at], 2024020000 + at)
    assert changed and all((day[k], k) > cut for k in changed)


def test_a_history_in_chunks_gives_the_same(spark):
    log = tables.team_log(league(spark, 120).unionByName(history(spark)))
    # Long runs over several chunks, unknown outcomes within and between them, and no team or date.
    runs = [(9000 + i, 2024, f"2024-{10 + i // 28:02d}-{1 + i % 28:02d}", "R", "S", *((None,) * 3 if i % 7 == 3 or 30 <= i < 42 else (3, 1, 4) if i < 25 or i >= 60 else (0, 1, 1))) for i in range(80)]
    runs += [(9900 + i, 2024, None if i % 2 else "2024-10-01", None, "S", i, 2, i + 2) for i in range(6)]
    log = log.unionByName(tables.team_log(some_games(spark, runs))).persist()

    def full(x):
        return rolling.streak(rolling.venue_rates(rolling.played_and_rest(rolling.multi_window(rolling.rolling_means(x)))))

    read = lambda df: {(r.game_pk, r.team): tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()}
    want = read(full(log))
    for size in (5, 64):
        got = full(rolling.spread(log, halo=40, size=size))
        assert read(rolling.own(got).select(*full(log).columns)) == want
    assert {r.win_streak for r in full(log).where("team = 'R'").select("win_streak").collect()} >= {21, -1}


def test_contests_come_back_from_the_log(spark):
    g = league(spark, 30)
    out = features.contests(tables.team_log(g, carry=True), ["goals_for"])
    assert sorted(map(tuple, out.collect())) == sorted((*r, r.home_score, r.away_score) for r in g.collect())


def test_request_metrics(spark):
    log = spark.createDataFrame([("a" if i % 3 else None, 500 if i == 4 else 200, float(i), i // 2, i) for i in range(60)], "route string, status int, latency_ms double, ts int, id int")
    got = {r.route: (r.requests, r.errors, r.p50, r.p99) for r in scoring.request_metrics(log, recent=10).collect()}
    assert got == {"a": (40, 1, 52.0, 59.0), None: (20, 0, 42.0, 57.0)}


def test_distributions(spark):
    df = spark.createDataFrame([(3.5,), (6.2,), (0.8,)], "mu double")
    for pmf in (dist.poisson_pmf(F.col("mu"), 30), dist.nb2_pmf(F.col("mu"), 0.4, 30), dist.mixture_pmf(F.col("mu"), 0.4, 1.3, 30)):
        for r in df.select("mu", pmf.alias("p")).collect():
            assert abs(sum(r.p) - 1) < 1e-9 and len(r.p) == 31
    same = df.select(dist.nb2_pmf(F.col("mu"), 0.0).alias("a"), dist.poisson_pmf(F.col("mu")).alias("b")).collect()
    assert all(abs(x - y) < 1e-10 for r in same for x, y in zip(r.a, r.b))
    y = 4
    for r in df.select("mu", dist.poisson_pmf(F.col("mu")).alias("p"), dist.crps(dist.poisson_pmf(F.col("mu")), F.lit(y)).alias("c"), dist.quantile(dist.poisson_pmf(F.col("mu")), 0.9).alias("q"), dist.nb2_logpmf(F.lit(y), F.col("mu"), 0.4).alias("l")).collect():
        cdf = [sum(r.p[: k + 1]) for k in range(21)]
        assert abs(r.c - sum((c - (k >= y)) ** 2 for k, c in enumerate(cdf))) < 1e-10
        assert r.q == next(k for k, c in enumerate(cdf) if c >= 0.9)
        want = math.lgamma(y + 2.5) - math.lgamma(2.5) - math.lgamma(y + 1) - (y + 2.5) * math.log1p(0.4 * r.mu) + y * math.log(0.4 * r.mu)
        assert abs(r.l - want) < 1e-12


def test_distributions_are_plain_expressions(spark):
    """A distribution runs no array function row by row, and scores of a known length are those of any length, nulls too."""
    df = spark.createDataFrame([(0.0, 0), (2.5, 3), (900.0, 25), (6.0, None), (None, 2)], "mu double, y int")
    for pmf in (dist.poisson_pmf(F.col("mu")), dist.nb2_pmf(F.col("mu"), 0.4)):
        plan = df.select(pmf.alias("p"))._jdf.queryExecution().optimizedPlan().toString()
        assert "lambda" not in plan and "aggregate(" not in plan
        held = df.select("y", pmf.alias("p"))
        assert all(abs(sum(r.p) - 1) < 1e-12 for r in held.collect())
        p, y = F.col("p"), F.col("y")
        for a, b in held.select(F.struct(dist.crps(p, y), dist.quantile(p, 0.9)), F.struct(dist.crps(p, y, 20), dist.quantile(p, 0.9, 20))).collect():
            assert tuple(a) == tuple(b)
    none = spark.createDataFrame([(None, 1)], "p array<double>, y int")
    assert tuple(none.select(dist.crps(F.col("p"), F.col("y"), 20), dist.quantile(F.col("p"), 0.5, 20)).first()) == (None, None)


def test_dispersion_fit(spark):
    df = spark.createDataFrame([(y, 4.0) for y in [0, 0, 1, 1, 2, 3, 4, 6, 9, 14] * 5], "y int, mu double")
    assert 0.3 < models.fit_alpha(df) < 3
    assert models.fit_alpha(spark.createDataFrame([(4, 4.0)] * 20, "y int, mu double")) == 0.0


def test_holm(spark):
    df = spark.createDataFrame(list(enumerate([0.03, 0.001, 0.02, 0.8])), "idx int, p double")
    assert [round(r.p_holm, 6) for r in scoring.holm(df).orderBy("idx").collect()] == [0.06, 0.004, 0.06, 0.8]


def test_bootstrap_of_a_clear_difference(spark):
    a = spark.createDataFrame([(i, str(i % 3), 1.0) for i in range(6)], "game_key int, block_key string, score double")
    b = a.withColumn("score", F.col("score") + 0.2)
    r = resample.block_bootstrap(resample.block_sums(a, b), n_boot=200).first()
    assert (r.blocks, r.games, r.significant) == (3, 6, True) and abs(r.mean_diff + 0.2) < 1e-9


def test_flat_stakes(spark):
    rows = [(0.65 if i % 2 else 0.35, i % 2, 0.5) for i in range(20)]
    df = spark.createDataFrame(rows, "p_over double, y_over int, reference_p_over double")
    r = scoring.flat_stakes(df, [0.05]).first()
    assert (r.bets, r.roi) == (20, 1.0)
    assert scoring.flat_stakes(df.withColumn("p_over", F.lit(0.5)), [0.05]).count() == 0


def test_reliability_edges(spark):
    df = spark.createDataFrame([(0.3, 1), (0.29, 0), (1.0, 1), (0.0, 0)], "p double, y int")
    # The fourth edge is 3 * 0.1, which is above 0.3.
    assert {r.bin: r.n for r in scoring.reliability(df).collect()} == {2: 2, 9: 1, 0: 1}


def test_ledger_and_reconcile(spark):
    log = spark.createDataFrame([(1, "a", 1, 6.0, [0.1]), (1, "a", 2, 6.2, None)], "game_pk long, artifact_id string, seq int, mu double, pmf array<double>")
    r = tables.latest_ledger(log, ["game_pk", "artifact_id"], ["pmf"], ["seq"]).collect()
    assert len(r) == 1 and r[0].mu == 6.2 and r[0].pmf == [0.1]
    p = spark.createDataFrame([(1, "d", "A", "B"), (999, "d", "C", "D")], "game_pk long, date string, home_team string, away_team string")
    res = spark.createDataFrame([(1, "d", "A", "B", 5.0, 1), (2, "d", "C", "D", 7.0, 2)], "game_pk long, date string, home_team string, away_team string, actual double, load_order int")
    assert [x.actual for x in tables.reconcile(p, res).orderBy("game_pk").collect()] == [5.0, 7.0]


def test_drift_of_a_constant(spark):
    df = spark.createDataFrame([(5.0,)] * 5, "value double")
    r = scoring.psi(df, df, "value").first()
    assert r.bins == 1 and r.psi == 0 and r.status == "stable"


def test_live_update(spark):
    f = spark.createDataFrame([(1, 6.0), (2, 6.0), (3, 6.0)], "game_pk long, mu double")
    s = spark.createDataFrame([(1, 3, 2, 3, "00:00", "LIVE"), (2, 6, 1, 2, "invalid", "LIVE"), (3, 0, 0, 1, "20:00", "FUT")], "game_pk long, home_score int, away_score int, period int, clock string, game_state string")
    got = {r.game_pk: r.pmf for r in live.score_live(s, f).collect()}
    assert got[1][5] == 1.0 and all(abs(sum(p) - 1) < 1e-9 for p in got.values())


def test_latest_state_of_a_stream_is_that_of_the_table(spark, tmp_path):
    rows = [(i % 4, i, float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "game_pk long, event_id long, value double").withColumn("ts", F.timestamp_seconds(F.col("event_id")))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.latest_state(stream, "game_pk", ["ts", "event_id"], ["value"]).writeStream.format("memory").queryName("latest").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {r.game_pk: r.value for r in live.latest_state(df, "game_pk", ["ts", "event_id"], ["value"]).collect()}
    assert {r.game_pk: r.value for r in spark.table("latest").collect()} == want


def test_sources(spark, tmp_path):
    week = '{"gameWeek": [{"date": "2024-10-10", "games": [{"id": 1, "season": 20242025, "gameType": 2, "gameState": "FINAL", "homeTeam": {"placeName": {"default": "Boston"}, "commonName": {"default": "Bruins"}, "score": 4}, "awayTeam": {"placeName": {"default": "Toronto"}, "commonName": {"default": "Leafs"}, "score": 2}}, {"id": 2, "season": 20242025, "gameType": 3, "gameState": "FUT", "homeTeam": {}, "awayTeam": {}}]}]}'
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.json").write_text(week)
    r = src.read_schedules(spark, str(tmp_path / "w")).collect()
    assert len(r) == 1 and (r[0].total_goals, r[0].game_type, r[0].home_team) == (6, "R", "Boston Bruins")
    up = src.read_schedules(spark, str(tmp_path / "w"), include_upcoming=True)
    assert [x.game_pk for x in src.upcoming(up, "2024-10-09", 2).collect()] == [2]
    src.write_seasons(up, str(tmp_path / "s"))
    assert src.read_seasons(spark, str(tmp_path / "s"), ["20242025"]).count() == 2
    assert src.stale_seasons(spark, str(tmp_path / "s")).count() == 0
    box = spark.read.schema(src.BOXSCORE).json(spark.sparkContext.parallelize(['{"game_pk": 1, "playerByGameStats": {"homeTeam": {"goalies": [{"playerId": 1, "toi": "59:00"}, {"playerId": 2, "toi": "1:01:00"}]}, "awayTeam": {"goalies": []}}}']))
    g = src.starters(box).first()
    assert (g.home_goalie_id, g.away_goalie_id, g.away_saves) == (2, None, 0)


@pytest.mark.parametrize("code,ok", [("20232024", True), ("20232025", False), ("abc", False)])
def test_season_codes(spark, code, ok):
    assert spark.range(1).select(scalars.valid_season(F.lit(code))).first()[0] is ok


def test_higher_quantile_and_index(spark):
    df = spark.range(10).select(F.col("id").cast("double").alias("e"))
    assert scoring.higher_quantile(df, "e", 0.9).first().radius == 9.0
    idx = rolling.chronological_index(league(spark)).orderBy("idx").select("idx", "date", "game_pk").collect()
    assert [r.idx for r in idx] == list(range(160)) and idx == sorted(idx, key=lambda r: (r.date, r.game_pk))
