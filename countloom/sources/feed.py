"""Expected-goals feeds: readers and the routes from their column sets to one row a contest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import tables

COLUMNS = ["season", "date", "home_team", "away_team", "home_xg", "away_xg"]
KEY = ["season", "date", "home_team", "away_team"]
#: The names under which feeds carry a field.
TEAM, OPPONENT = ["team", "playerTeam", "name"], ["opposingTeam", "opponent", "opp"]
XGF, SIDE, DATE = ["xGoalsFor", "xGoals_for", "xGF"], ["home_or_away", "homeOrAway", "HoA"], ["gameDate", "date", "game_date"]
ALIASES = {
    "season": ["season"],
    "date": ["date", "gameDate", "game_date"],
    "home_team": ["homeTeam", "home_team", "homeTeamName", "home_team_name", "home"],
    "away_team": ["awayTeam", "away_team", "awayTeamName", "away_team_name", "away"],
    "home_xg": ["home_xG", "home_xg", "homeExpectedGoals", "home_xGoals", "xGoalsForHome"],
    "away_xg": ["away_xG", "away_xg", "awayExpectedGoals", "away_xGoals", "xGoalsForAway"],
}


Names = tuple[dict[str, str], dict[str, str]]
NO_NAMES: Names = ({}, {})


def read_feed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A CSV feed as text columns; values are cast where they are used, so one bad value does not lose a file."""
    return spark.read.option("header", True).csv(path)


def _code(season: Column) -> Column:
    """20232024 for 2023; a longer code as it is."""
    return F.when(season.rlike("^[0-9]{1,4}$"), F.concat(season, (season.try_cast("int") + 1).cast("string"))).otherwise(season)


def _season(df: DataFrame, name: str, day: str) -> Column:
    """The season of a row by its column, or by its day: a season begins in August at the earliest."""
    start = F.col(name).cast("string") if name in df.columns else scalars.season_start(F.col(day), 8).cast("string")
    return _code(start)


def is_team_feed(df: DataFrame) -> bool:
    """Whether the feed has a row for each side of a contest."""
    have = set(df.columns)
    return {"xGoalsFor", "home_or_away"} <= have and bool({"gameDate", "gameId"} & have)


def pair_sides(feed: DataFrame, names: Names = NO_NAMES) -> DataFrame:
    """One row a contest from rows by team: by gameId, or without one by season, day and mutual opponent.

    Only rows of all situations count, where the feed tells them apart. A
    side that is missing leaves its contest out; of equal contests one stays.
    """
    pick = lambda names, what: F.col(tables.first_existing(feed, names, what))
    if "situation" in feed.columns:
        feed = feed.where(F.lower("situation") == "all")
    rows = feed.select(
        *([F.col("gameId").alias("id")] if "gameId" in feed.columns else []),
        *([F.col("season")] if "season" in feed.columns else []),
        scalars.parse_day(pick(DATE, "date")).alias("date"), scalars.normalize_name(pick(TEAM, "team"), *names).alias("team"), scalars.normalize_name(pick(OPPONENT, "opponent"), *names).alias("opponent"),
        F.upper(F.trim(pick(SIDE, "side"))).alias("side"), pick(XGF, "xGoalsFor").try_cast("double").alias("xg"),
    )
    rows = rows.withColumn("season", _season(rows, "season", "date"))
    key = ["id"] if "gameId" in feed.columns else ["season", "date", "home", "away"]
    home = F.col("side") == "HOME"
    rows = rows.where("side IN ('HOME', 'AWAY')").withColumns({"home": F.when(home, F.col("team")).otherwise(F.col("opponent")), "away": F.when(home, F.col("opponent")).otherwise(F.col("team"))})
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    # Both sides of a contest meet in one grouped pass instead of a self-join.
    both = rows.groupBy(*key).agg(
        of("HOME", "season").alias("season_"), of("HOME", "date").alias("date_"), of("HOME", "team").alias("home_team"), of("AWAY", "team").alias("away_team"), of("HOME", "xg").alias("home_xg"), of("AWAY", "xg").alias("away_xg")
    )
    out = both.select(F.col("season_").alias("season"), F.col("date_").alias("date"), "home_team", "away_team", "home_xg", "away_xg")
    return out.na.drop(subset=COLUMNS[1:]).dropDuplicates(KEY)


def contest_rows(feed: DataFrame, season: str | None = None, names: Names = NO_NAMES) -> DataFrame:
    """A feed that has a row a contest, under the usual names; rows with nulls go, and so do those of other seasons if one is asked for.

    A row without a season of its own is of the asked one; if none is asked for, its day decides.
    """
    pick = {k: tables.first_existing(feed, v, k) for k, v in ALIASES.items() if k != "season"}
    own = F.col("season").cast("string") if "season" in feed.columns else F.lit(None).cast("string")
    dated = feed.withColumns({"__day": scalars.parse_day(F.col(pick["date"])), "__own": F.when(~F.lower(own).isin("nan", "none", ""), own)})
    default = F.lit(season) if season else _season(dated, "__none", "__day")
    out = dated.select(
        F.coalesce(_code(F.col("__own")), default).alias("season"), F.col("__day").alias("date"), *[scalars.normalize_name(F.col(pick[c]), *names).alias(c) for c in ("home_team", "away_team")], *[F.col(pick[c]).try_cast("double").alias(c) for c in ("home_xg", "away_xg")]
    ).na.drop()
    return out.where(F.col("season") == season) if season else out


def standardize(feed: DataFrame, season: str | None = None, names: Names = NO_NAMES) -> DataFrame:
    """season, date, home_team, away_team, home_xg, away_xg by whichever of the two layouts the feed has; names has
    the teams' other names and abbreviations."""
    if not is_team_feed(feed):
        return contest_rows(feed, season, names)
    out = pair_sides(feed, names)
    return out.where(F.col("season") == season) if season else out
