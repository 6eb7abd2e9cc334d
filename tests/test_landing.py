import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from countloom.functions import scalars
from countloom.operators import ledger, tables
from countloom.sources import feed, games, landing, sinks

KEY = ["season", "date", "home_team", "away_team"]


def csv(folder, name, rows, header="season,gameDate,homeTeamName,away_team_name,homeExpectedGoals,xGoalsForAway"):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        f.write("\n".join([header, *rows]))


def parse(spark):
    return lambda names: feed.standardize(feed.read_feed(spark, names))


def rows_of(df):
    return sorted(map(tuple, df.select(*feed.COLUMNS).collect()))


def test_files_are_taken_in_once(spark, tmp_path):
    src, store = f"{tmp_path}/in", f"{tmp_path}/store"
    csv(src, "a.csv", ["2023,20240105,Reds,Blues,2.5,1.5", "2023,20240106,Reds,Greens,3.0,0.5", "2022,20230106,Reds,Greens,bad,0.5"])
    assert landing.take_in(spark, src, store, parse(spark)) == 1
    assert landing.take_in(spark, src, store, parse(spark)) == 0 and landing.last_load(spark, store) == 1
    want = [("20232024", dt.date(2024, 1, 5), "reds", "blues", 2.5, 1.5), ("20232024", dt.date(2024, 1, 6), "reds", "greens", 3.0, 0.5)]
    assert rows_of(landing.read(spark, store, KEY)) == want
    # A new file corrects a contest and brings another season; only it is read.
    csv(src, "b.csv", ["2023,20240106,Reds,Greens,4.0,0.5", "2024,20250106,Reds,Greens,1.0,1.0"])
    read = []
    assert landing.take_in(spark, src, store, lambda names: read.extend(names) or parse(spark)(names)) == 1
    assert len(read) == 1 and read[0].endswith("b.csv")
    got = rows_of(landing.read(spark, store, KEY))
    assert [r[4] for r in got] == [2.5, 4.0, 1.0]
    assert rows_of(landing.read(spark, store, KEY, ["20242025"])) == got[2:]


def test_a_load_that_broke_off_leaves_nothing(spark, tmp_path):
    src, store = f"{tmp_path}/in", f"{tmp_path}/store"
    csv(src, "a.csv", ["2023,20240105,Reds,Blues,2.5,1.5"])
    landing.take_in(spark, src, store, parse(spark))
    before = rows_of(landing.read(spark, store, KEY))
    csv(src, "b.csv", ["2023,20240107,Reds,Blues,9.5,9.5"])
    # The rows of load 2 were written, and then the job was killed.
    lost = parse(spark)([f"{src}/b.csv"]).withColumn("__by", F.lit("20232024"))
    lost.unionByName(lost.withColumn("home_xg", F.lit(0.0))).write.partitionBy("__by").parquet(f"{store}/data/load=2")
    assert rows_of(landing.read(spark, store, KEY)) == before
    assert landing.take_in(spark, src, store, parse(spark)) == 1
    assert [r[4] for r in rows_of(landing.read(spark, store, KEY))] == [2.5, 9.5]


def test_bulk_fills_only_missing_seasons(spark, tmp_path):
    store, calls = f"{tmp_path}/store", []
    bulk = spark.createDataFrame([(f"{y}{y + 1}", dt.date(y, 11, 1), "a", "b", float(y), 1.0) for y in (2021, 2022, 2023)], "season string, date date, home_team string, away_team string, home_xg double, away_xg double")

    def table():
        calls.append(1)
        return bulk

    assert [r[0] for r in rows_of(landing.load_seasons(spark, store, KEY, ["20222023"], table))] == ["20222023"]
    assert [r[0] for r in rows_of(landing.load_seasons(spark, store, KEY, ["2022"], table))] == ["20222023"] and len(calls) == 1
    assert [r[0] for r in rows_of(landing.load_seasons(spark, store, KEY, ["20222023", "20232024"], table))] == ["20222023", "20232024"]
    assert len(calls) == 2 and landing.manifest(spark, store).where("kind = 'season'").count() == 2
    assert landing.load_seasons(spark, f"{tmp_path}/none", KEY, ["1999"], table).count() == 0
    with pytest.raises(ValueError):
        landing.read(spark, f"{tmp_path}/none", KEY)


def test_only_new_ids_are_appended(spark, tmp_path):
    store, schema = f"{tmp_path}/store", "game_pk long, season string, saves int"
    first = spark.createDataFrame([(1, "20232024", 10), (2, "20232024", 20)], schema)
    assert landing.append_new(first, store).count() == 2
    more = spark.createDataFrame([(2, "20232024", 99), (3, "20242025", 30)], schema)
    assert sorted((r.game_pk, r.saves) for r in landing.append_new(more, store).collect()) == [(1, 10), (2, 20), (3, 30)]
    assert landing.append_new(more, store).count() == 3 and landing.last_load(spark, store) == 2


def test_contest_feeds_by_all_their_names(spark):
    for i in range(5):
        pick = {k: v[min(i, len(v) - 1)] for k, v in feed.ALIASES.items()}
        df = spark.createDataFrame([("2023", "2024-01-05", "Reds", "Blues", "2.5", "1.5")], ", ".join(f"`{pick[k]}` string" for k in feed.ALIASES))
        assert rows_of(feed.standardize(df)) == [("20232024", dt.date(2024, 1, 5), "reds", "blues", 2.5, 1.5)]
    bare = spark.createDataFrame([("2024-01-05 19:00:00", "Reds", "Blues", "2.5", "1.5")], "date string, home string, away string, home_xG string, away_xG string")
    assert [r[0] for r in rows_of(feed.standardize(bare))] == ["20232024"] and [r[0] for r in rows_of(feed.standardize(bare, "20222023"))] == ["20222023"]


def test_season_assembly_and_dates(spark):
    g = spark.createDataFrame([(1, 2024, "2024-10-02", "x"), (1, 2024, "2024-10-01", "y"), (2, 2023, "2023-10-01", "z")], "game_pk long, season int, date string, note string")
    assert [(r.game_pk, r.note) for r in games.assemble_season(g, 2024).collect()] == [(1, "y")]
    first, last = scalars.season_dates(F.lit("20232024"))
    r = spark.range(1).select(first.alias("a"), last.alias("b"), scalars.recent_seasons(F.lit("2024-06-10").cast("date"), 2).alias("c"), scalars.parse_day(F.lit("20240105.0")).alias("d"), scalars.parse_day(F.lit("x")).alias("e")).first()
    assert (r.a, r.b, r.c, r.d, r.e) == (dt.date(2023, 10, 1), dt.date(2024, 6, 30), ["20222023", "20232024"], dt.date(2024, 1, 5), None)


def test_text_sinks_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.25, 0.75], {"a": 1.5}, 'say "x",\ny'), (2, None, None, None)], "game_pk long, pmf array<double>, features map<string,double>, note string")
    sinks.write_csv(df, f"{tmp_path}/c")
    assert sorted(map(str, sinks.read_csv(spark, f"{tmp_path}/c", df.schema).collect())) == sorted(map(str, df.collect()))
    assert sinks.to_text(df).columns == ["game_pk", "pmf_json", "features_json", "note"]
    sinks.write_report({"ranking": df, "ablation": df.select("game_pk")}, f"{tmp_path}/r")
    assert spark.read.json(f"{tmp_path}/r/ablation").count() == 2


LEDGER = "game_pk long, artifact_id string, forecast_kind string, predicted_at date, mu double, pmf array<double>, features map<string,double>"
DAY = dt.date(2024, 1, 1)


def batch(spark, *rows):
    return spark.createDataFrame([(pk, "m", "pregame", DAY, mu, pmf, None) for pk, mu, pmf in rows], LEDGER)


def ledger_rows(df):
    return sorted((r.game_pk, r.mu, r.pmf) for r in df.collect())


def test_ledger_snapshots_give_what_all_batches_give(spark, tmp_path):
    path, snaps = f"{tmp_path}/ledger", f"{tmp_path}/snapshots"
    batches = [batch(spark, (1, 5.0, [1.0]), (2, 6.0, None)), batch(spark, (1, 5.5, None)), batch(spark, (2, 6.5, [0.5, 0.5]), (3, 7.0, None)), batch(spark, (1, 4.0, None), (3, 7.5, [0.1]))]
    for i, b in enumerate(batches):
        ledger.append(b, i, path)
        if i in (1, 2):
            assert ledger.compact(spark, path, snaps, buckets=3) == i
        want = ledger_rows(ledger.load(spark.read.parquet(path)))
        assert ledger_rows(ledger.load(ledger.writes(spark, path, snaps))) == want
    assert want == [(1, 4.0, [1.0]), (2, 6.5, [0.5, 0.5]), (3, 7.5, [0.1])]
    # A batch that the snapshot holds is written again: nothing changes, and it is not read.
    ledger.append(batches[0], 0, path)
    assert ledger_rows(ledger.load(ledger.writes(spark, path, snaps))) == want
    assert {r.batch_id for r in ledger.writes(spark, path, snaps).select("batch_id").collect()} <= {1, 2, 3}
    assert ledger.compact(spark, path, snaps) == 3 and ledger.compact(spark, path, snaps) == 3
    assert ledger_rows(ledger.load(ledger.writes(spark, path, snaps))) == want


def test_a_compaction_that_broke_off_is_not_read(spark, tmp_path):
    path, snaps = f"{tmp_path}/ledger", f"{tmp_path}/snapshots"
    ledger.append(batch(spark, (1, 5.0, None)), 0, path)
    ledger.compact(spark, path, snaps)
    ledger.append(batch(spark, (1, 6.0, None)), 1, path)
    batch(spark, (1, 99.0, None)).withColumn("batch_id", F.lit(1).cast("long")).write.parquet(f"{snaps}/data/version=1")
    assert ledger_rows(ledger.load(ledger.writes(spark, path, snaps))) == [(1, 6.0, None)]
    assert ledger.compact(spark, path, snaps) == 1
    assert ledger_rows(ledger.load(ledger.writes(spark, path, snaps))) == [(1, 6.0, None)]


def test_a_hot_key_and_ties(spark):
    """One key has nearly all writes: they are aggregated before they move; equal orders give one row whatever the partitioning."""
    log = spark.range(20_000).select((F.when(F.col("id") % 100 == 0, F.col("id"))).alias("k"), (F.col("id") % 500).alias("at"), F.when(F.col("id") % 7 == 0, F.col("id")).alias("v"), F.col("id").alias("w"))
    got = [tables.latest_ledger(log.repartition(n), ["k"], ["v"], ["at"]).where("k IS NULL").first() for n in (2, 5)]
    assert got[0] == got[1] and got[0]["at"] == 499 and got[0].v % 7 == 0
    plan = tables.latest_ledger(log, ["k"], ["v"], ["at"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Aggregate") >= 2


def test_required_columns(spark):
    df = spark.createDataFrame([(1,)], "a int")
    tables.require_columns(df, ["a"])
    with pytest.raises(ValueError, match="missing"):
        tables.require_columns(df, ["a", "b"])
    with pytest.raises(ValueError, match="no rows"):
        tables.require_columns(df.limit(0), ["a"])
