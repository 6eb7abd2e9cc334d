"""Registered queries of stores that grow by loads: seasons, feeds as files, and the ledger with snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distributions as dist
from ..functions import scalars
from ..operators import ledger
from ..sources import feed, landing
from ..sources.games import games_view
from ..sources.shared import shared_dir, written
from . import queries, serving_queries  # noqa: F401  (registers the SQL of the feed)
from .queries import GAMES, PMF, SQL, WITH, query, rounded


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {GAMES} SELECT game_pk, CAST(season AS VARCHAR) || CAST(season + 1 AS VARCHAR) AS season, date, home_team, away_team, CAST(total_goals AS BIGINT) AS total_goals FROM games")
def landed_seasons(spark, d):
    """A store that has some seasons, takes missing ones from the bulk table, and then appends all contests whose ids it lacks."""
    g = games_view(spark, d).select("game_pk", scalars.season_code(F.col("season")).alias("season"), "date", "home_team", "away_team", F.col("total_goals").cast("long").alias("total_goals"))
    g, store = written(g, "games"), _new_folder(spark, "store")
    landing.commit(g.where(F.col("season").isin("19921993", "19931994")), store)
    landing.load_seasons(spark, store, ["game_pk"], ["1993", "1994", "19951996"], lambda: g)
    return landing.append_new(g, store)


@query(SQL["xg_feed"])
def feed_files(spark, d):
    """Expected goals as CSV files of one row a side, taken in by two loads; files that were read are not read again."""
    g = queries.xg_games(spark, d)
    side = lambda team, opponent, xg, s: F.struct(F.col(team).alias("team"), F.col(opponent).alias("opposingTeam"), F.col(xg).alias("xGoalsFor"), F.lit(s).alias("home_or_away"))
    rows = g.select("season", F.date_format("date", "yyyyMMdd").alias("gameDate"), F.lit("all").alias("situation"), F.explode(F.array(side("home_team", "away_team", "home_xg", "HOME"), side("away_team", "home_team", "away_xg", "AWAY"))).alias("s"))
    rows, source, store = written(rows.select("season", "gameDate", "situation", "s.*"), "feed"), _new_folder(spark, "feed"), _new_folder(spark, "store")
    parse = lambda names: feed.standardize(feed.read_feed(spark, names))
    for n, part in enumerate((F.col("season") < 1995, F.col("season") >= 1995)):
        rows.where(part).write.option("header", True).csv(f"{source}/part={n}")
        landing.take_in(spark, source, store, parse)
    landing.take_in(spark, source, store, parse)
    return rounded(landing.read(spark, store, feed.KEY).withColumns({"home_team": F.lower("home_team"), "away_team": F.lower("away_team")}))


@query(f"""{WITH}, {PMF}, o AS (SELECT game_pk, sum(p) FILTER (WHERE k > 6.5) AS over_65 FROM pmf GROUP BY game_pk)
SELECT game_pk, round(mu + CASE WHEN game_pk % 3 = 0 THEN 2 WHEN game_pk % 2 = 0 THEN 1 ELSE 0 END, 6) AS mu, round(over_65, 6) AS over_65 FROM fc JOIN o USING (game_pk)""")
def ledger_snapshot(spark, d):
    """Three batches of forecasts with a snapshot after the second; later writes change mu and keep the distribution they do not have."""
    f = queries.forecasts(spark, d).select("game_pk", F.lit("m").alias("artifact_id"), F.lit("pregame").alias("forecast_kind"), F.col("date").alias("predicted_at"), "mu", dist.poisson_pmf(F.col("mu")).alias("pmf"))
    f, path, snapshots = written(f, "forecasts"), _new_folder(spark, "ledger"), _new_folder(spark, "snapshots")
    later = lambda by, more: f.where(F.col("game_pk") % by == 0).withColumns({"mu": F.col("mu") + more, "pmf": F.lit(None).cast("array<double>")})
    for n, batch in enumerate((f, later(2, 1), later(3, 2))):
        ledger.append(batch, n, path)
        if n == 1:
            ledger.compact(spark, path, snapshots)
    ledger.append(f, 0, path)  # a replay of what the snapshot holds
    held: DataFrame = ledger.load(ledger.writes(spark, path, snapshots), "m")
    return rounded(held.select("game_pk", "mu", dist.prob_over(F.col("pmf"), 6.5).alias("over_65")))
