"""Contest tables: the view over the order tables, and readers of landed JSON and CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def games_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One contest an order: the customer's nation at home against that of its first supplier, flags as scores."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    lines = read("lineitem").groupBy("l_orderkey").agg(
        F.min("l_suppkey").alias("suppkey"),
        F.count_if(F.col("l_returnflag") == "N").cast("int").alias("home_score"),
        F.count_if(F.col("l_returnflag") != "N").cast("int").alias("away_score"),
        F.count("*").cast("int").alias("total_goals"),
    )
    # 25 nations: a table of fixed size.
    home = F.broadcast(read("nation").select(F.col("n_nationkey").alias("hk"), F.col("n_name").alias("home_team")))
    away = F.broadcast(read("nation").select(F.col("n_nationkey").alias("ak"), F.col("n_name").alias("away_team")))
    return (
        read("orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("date"))
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(read("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(read("supplier").select("s_suppkey", "s_nationkey"), F.col("suppkey") == F.col("s_suppkey"))
        .join(home, F.col("c_nationkey") == F.col("hk"))
        .join(away, F.col("s_nationkey") == F.col("ak"))
        .where("home_team <> away_team")
        .select(F.col("o_orderkey").cast("long").alias("game_pk"), F.year("date").alias("season"), "date", "home_team", "away_team", "home_score", "away_score", "total_goals")
    )


_SIDE = "struct<placeName: struct<default: string>, commonName: struct<default: string>, score: int>"
SCHEDULE = f"gameWeek array<struct<date: string, games: array<struct<id: long, season: long, gameType: int, gameState: string, homeTeam: {_SIDE}, awayTeam: {_SIDE}>>>>"
#: States of finished and of scheduled contests, and the names of contest types.
DONE, SCHEDULED = ("OFF", "FINAL"), ("FUT", "PRE", "LIVE")
TYPES = {2: "R", 3: "P"}


def parse_schedule(weeks: DataFrame, include_upcoming: bool = False) -> DataFrame:
    """Contests of schedule payloads (column gameWeek): finished ones, and scheduled ones if asked for."""
    g = weeks.select(F.explode("gameWeek").alias("d")).select("d.date", F.explode("d.games").alias("g"))
    name = lambda side: F.concat_ws(" ", F.col(f"g.{side}.placeName.default"), F.col(f"g.{side}.commonName.default"))
    score = lambda side: F.coalesce(F.col(f"g.{side}.score"), F.lit(0))
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])[F.col("g.gameType")], F.lit("O"))
    return g.where(F.col("g.gameState").isin(*DONE, *(SCHEDULED if include_upcoming else ()))).select(
        F.col("g.id").alias("game_pk"), F.col("g.season").cast("string").alias("season"), kind.alias("game_type"), F.to_date("date").alias("date"),
        name("homeTeam").alias("home_team"), name("awayTeam").alias("away_team"), score("homeTeam").alias("home_score"), score("awayTeam").alias("away_score"),
        (score("homeTeam") + score("awayTeam")).alias("total_goals"), F.col("g.gameState").alias("game_state"),
    )


def read_schedules(spark: SparkSession, path: str, include_upcoming: bool = False) -> DataFrame:
    return parse_schedule(spark.read.schema(SCHEDULE).json(path, multiLine=True), include_upcoming)


def assemble_season(games: DataFrame, season: str, order: str = "date") -> DataFrame:
    """A season's contests, the first row of each id in the order given."""
    rows = games.where(F.col("season") == season)
    first = rows.groupBy(F.col("game_pk").alias("id")).agg(F.min_by(F.struct(*games.columns), order).alias("row"))
    return first.select("row.*")


def write_seasons(games: DataFrame, path: str) -> None:
    """Store by season; seasons that are not in games stay as they are."""
    games.write.partitionBy("season").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def read_seasons(spark: SparkSession, path: str, seasons: list) -> DataFrame:
    """Only the asked seasons' partitions are read."""
    return spark.read.parquet(path).where(F.col("season").isin(seasons))


def stale_seasons(spark: SparkSession, path: str, hours: int = 6) -> DataFrame:
    """Seasons whose newest file is older than hours."""
    newest = spark.read.parquet(path).groupBy("season").agg(F.max("_metadata.file_modification_time").alias("newest"))
    return newest.where(F.col("newest") < F.current_timestamp() - F.expr(f"interval {hours} hours"))


def upcoming(games: DataFrame, as_of: str, days_ahead: int = 7) -> DataFrame:
    """Scheduled contests from as_of to days_ahead later, one row an id."""
    day = F.to_date(F.lit(as_of))
    return games.where(F.col("game_state").isin(*SCHEDULED) & F.col("date").between(day, F.date_add(day, days_ahead))).dropDuplicates(["game_pk"])


_GOALIE = "struct<playerId: long, name: struct<default: string>, starter: boolean, toi: string, saves: int, shotsAgainst: int, goalsAgainst: int, savePctg: double>"
BOXSCORE = f"game_pk long, playerByGameStats struct<homeTeam: struct<goalies: array<{_GOALIE}>>, awayTeam: struct<goalies: array<{_GOALIE}>>>"


def starters(boxscores: DataFrame) -> DataFrame:
    """The starting goalie of each side: the first marked one, else the one with most time on ice."""
    from ..functions.scalars import duration_seconds

    cols = [F.col("game_pk")]
    for side in ("home", "away"):
        all_ = F.col(f"playerByGameStats.{side}Team.goalies")
        times = F.transform(all_, lambda g: duration_seconds(g.toi))
        first = F.get(F.filter(all_, lambda g: g.starter), F.lit(0))
        longest = F.get(all_, (F.array_position(times, F.array_max(times)) - 1).cast("int"))
        g = F.coalesce(first, longest)
        zero = lambda c: F.coalesce(c, F.lit(0))  # noqa: B023, E731
        cols += [
            g.playerId.alias(f"{side}_goalie_id"), g["name"].default.alias(f"{side}_goalie_name"), zero(g.saves).alias(f"{side}_saves"),
            zero(g.shotsAgainst).alias(f"{side}_shots_against"), zero(g.goalsAgainst).alias(f"{side}_goals_against"), F.coalesce(g.savePctg, F.lit(0.0)).alias(f"{side}_save_pct"),
        ]
    return boxscores.select(*cols)
