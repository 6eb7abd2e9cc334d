from countloom.operators import signals


def test_xg_of_a_repeated_key_doubles_no_row(spark):
    feed = spark.createDataFrame([(2023, "2023-10-10", "A", "B", 3.0, 2.0), (2023, "2023-10-10", "A", "B", 4.0, 2.0)], "season int, date string, home_team string, away_team string, home_xg double, away_xg double")
    log = spark.createDataFrame([(1, 2023, "2023-10-10", "A", "B"), (2, 2023, "2023-10-12", "A", "C"), (3, 2023, "2023-10-10", "B", "A")], "game_pk long, season int, date string, team string, opponent string")
    got = {r.game_pk: r for r in signals.add_xg(log, signals.xg_log(feed), (5,)).collect()}
    assert len(got) == 3 and (got[1].xgf, got[1].xga, got[3].xgf) == (3.5, 2.0, 2.0)
    assert got[1].avg_xgf_5g is None and got[2].xgf is None and got[2].avg_xgf_5g == 3.5
    assert signals.match_rate(signals.add_xg(log, signals.xg_log(feed), ())).first().match_rate == 2 / 3


def test_goalie_form_uses_earlier_starts_of_the_side(spark):
    names = "game_pk long, home_goalie_id long, home_saves int, home_shots_against int, home_goals_against int, away_goalie_id long, away_saves int, away_shots_against int, away_goals_against int"
    rows = [(i, 7, 9, 10, 1, None if i == 2 else 8, 5, 10, 5) for i in range(5)]
    games = spark.createDataFrame([(i, f"2024-10-{10 + i}") for i in range(6)], "game_pk long, date string")
    got = {r.game_pk: r for r in signals.add_goalies(games, spark.createDataFrame(rows, names)).collect()}
    assert len(got) == 6 and got[2].home_goalie_sv_pct is None and got[3].home_goalie_sv_pct == 0.9 and got[4].home_goalie_gaa == 1.0
    assert got[2].away_goalie_gaa is None and got[4].away_goalie_gaa == 5.0 and got[5].home_goalie_sv_pct is None
