import datetime as dt
import random

from pyspark.sql import functions as F

from countloom.operators import numbering, rolling, signals, tables
from countloom.sources import games as src

from .test_core import GAMES, league


def test_positions_of_any_order(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b"]), rng.choice([None, 1, 2]), i, "keep") for i in range(300)]
    df = spark.createDataFrame(rows, "a string, b int, i long, `part.row` string").repartition(5)
    got = numbering.number_rows(df, ["a", "b", "i"], "at").collect()
    last = lambda v: (v is None, v or 0) if not isinstance(v, str) else (False, v)
    assert [r.i for r in sorted(got, key=lambda r: r["at"])] == [r[2] for r in sorted(rows, key=lambda r: ((r[0] is None, r[0] or ""), last(r[1]), r[2]))]
    assert {r["part.row"] for r in got} == {"keep"} and sorted(r["at"] for r in got) == list(range(300))
    assert numbering.number_rows(df.limit(0), ["a"], "at").count() == 0


def test_one_value_on_most_rows_is_split(spark):
    """90 % of the rows share a date and a key, or a value: every row has its place and no partition holds the lot."""
    df = spark.range(20_000, numPartitions=4).select(F.when(F.col("id") % 10 > 0, F.lit(5)).otherwise(F.col("id")).alias("v"), F.lit(1).alias("game_pk"))
    df = df.repartition(4)
    out = rolling.chronological_index(df, "v")
    assert out.agg(F.count_distinct("idx"), F.min("idx"), F.max("idx")).first() == (20_000, 0, 19_999)
    assert out.agg(F.max(F.when(F.col("v") < 5, F.col("idx"))), F.min(F.when(F.col("v") > 5, F.col("idx")))).first() == (0, 18_001)
    by = [F.col("v"), F.monotonically_increasing_id()]
    sizes = [r["count"] for r in df.select("*", by[1].alias("t")).repartitionByRange(4, "v", "t").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 10_000


def test_pairs_and_goalies_in_chunks_give_the_same(spark):
    g = league(spark, 150).withColumn("home_team", F.when(F.col("game_pk") % 3 > 0, "T1").otherwise(F.col("home_team"))).withColumn("away_team", F.when(F.col("game_pk") % 3 > 0, "T2").otherwise(F.col("away_team"))).persist()
    read = lambda df: sorted(map(str, df.collect()))
    whole = read(rolling.head_to_head(g, 4).select("game_pk", "h2h_avg_goals"))
    assert len(whole) == 150 and read(rolling.head_to_head(g, 4, size=7).select("game_pk", "h2h_avg_goals")) == whole
    s = g.select("game_pk", "date", (F.col("game_pk") % 2).alias("home_goalie_id"), (F.col("game_pk") % 40).alias("home_saves"), (F.col("game_pk") % 40 + 2).alias("home_shots_against"), (F.col("game_pk") % 3).alias("home_goals_against"))
    s = s.withColumn("home_goalie_id", F.when(F.col("game_pk") % 11 > 0, F.col("home_goalie_id")))
    want = read(signals.goalie_form(s, "home"))
    assert read(signals.goalie_form(s, "home", size=13)) == want and len(want) < 150
    assert sum("None" in r for r in want) == 6  # the first three starts of two goalies


def test_single_chunk_needs_no_ranks(spark):
    log = tables.team_log(league(spark, 40))
    assert rolling.spread(log).columns == log.columns
    assert rolling.spread(log, size=5).columns == [*log.columns, "__chunk", "__own"]
    assert rolling.own(rolling.spread(log)).count() == 80 == rolling.own(rolling.spread(log, size=5)).count()
    assert rolling.spread(log.limit(0)).count() == 0


def test_chunks_by_days_neither_sort_nor_write_the_table(spark, monkeypatch):
    """Chunks begin with a date and give the same windows; only a date longer than a chunk is numbered row by row."""
    log = tables.team_log(league(spark, 120)).persist()
    features = lambda df: sorted(map(str, rolling.own(rolling.streak(rolling.played_and_rest(rolling.rolling_means(df, 6)))).select("game_pk", "team", "avg_gf", "games_played", "rest_days", "win_streak").collect()))
    want = features(log)
    called = []
    monkeypatch.setattr(rolling, "number_rows", lambda *a, **k: called.append(1) or numbering.number_rows(*a, **k))
    for size in (7, 20):
        held = rolling.spread(log, halo=6, size=size)
        assert features(held) == want and held.groupBy("team", "__chunk").agg(F.count_if("__own").alias("n")).agg(F.max("n")).first()[0] < 2 * size
    assert not called
    one_day = log.withColumn("date", F.lit(dt.date(2024, 1, 1)))
    assert features(rolling.spread(one_day, halo=6, size=7)) == features(one_day) and called == [1]


def test_goalie_interactions(spark):
    df = spark.createDataFrame([(0.9, 0.8, 3.0, 2.0)], "home_goalie_sv_pct double, away_goalie_sv_pct double, home_avg_gf double, away_avg_gf double")
    r = signals.goalie_interactions(df).first()
    assert (r.home_goalie_vs_offense, round(r.away_goalie_vs_offense, 9)) == (1.8, 2.4)
    assert signals.goalie_interactions(df.drop("home_goalie_sv_pct")).columns == ["away_goalie_sv_pct", "home_avg_gf", "away_avg_gf", "away_goalie_vs_offense"]


def test_names(spark):
    from countloom.functions import scalars

    aliases, short = {"st louis blues": "St. Louis Blues"}, {"BOS": "Boston Bruins"}
    rows = [("St. Louis  Blues",), ("bos ",), ("New York",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(scalars.normalize_name(F.col("t"), aliases, short)).collect()]
    assert got == ["St. Louis Blues", "Boston Bruins", "new york", None]
    assert [r[0] for r in spark.createDataFrame([(None,), (-3.0,), (2.0,), (0.0,)], "d double").select(scalars.rest_bucket(F.col("d"))).collect()] == ["unknown", "away_rested", "home_rested", "even"]
    assert src.DONE and GAMES and dt.date


def test_tasks_follow_the_rows(spark, monkeypatch):
    """More rows are more tasks, not larger ones, in numbering, windows and in the groups that bring both sides together; the rows stay."""
    from countloom.plans import features
    from countloom.sources import shared

    games = spark.range(3000).select(F.col("id").alias("game_pk"), F.lit(2024).alias("season"), F.date_add(F.lit("2024-01-01"), (F.col("id") / 10).cast("int")).alias("date"), F.concat(F.lit("T"), F.pmod("id", F.lit(5))).alias("home_team"), F.concat(F.lit("U"), F.pmod("id", F.lit(7))).alias("away_team"), F.pmod("id", F.lit(4)).cast("int").alias("home_score"), F.pmod("id", F.lit(3)).cast("int").alias("away_score"))
    games = games.withColumn("total_goals", F.col("home_score") + F.col("away_score"))
    digest = lambda df: df.agg(F.sum(F.xxhash64(*[F.round(c, 9) if t == "double" else F.col(c) for c, t in sorted(df.dtypes)]).cast("decimal(38,0)"))).first()[0]
    want = digest(rolling.chronological_index(features.add_features(games)))
    monkeypatch.setattr(shared, "TASK_ROWS", 300)
    assert features.add_features(games).rdd.getNumPartitions() == 20
    log = shared.written(features.tables.team_log(games), "log")
    chunks = rolling.spread(log, halo=20, size=100)
    assert "__chunk" in chunks.columns and chunks.rdd.getNumPartitions() == 20
    plan = rolling.streak(rolling.played_and_rest(chunks))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
    assert digest(rolling.chronological_index(features.add_features(games))) == want
