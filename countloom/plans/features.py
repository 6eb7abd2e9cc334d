"""The feature pipeline over a contest table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import rolling, tables
from ..sources.shared import by_rows, written

WINDOWS = (5, 10, 20, 40)
BASE = ["avg_gf", "avg_ga", "avg_total", "win_pct", "rest_days", "is_back_to_back", "win_streak"]
CALENDAR = ["month", "day_of_week", "is_weekend", "days_into_season", "season_progress", "is_late_season", "is_early_season"]
CROSS = ["scoring_opportunity", "opponent_threat", "rest_advantage", "rest_advantage_capped", "form_diff", "combined_avg_total"]


def side_columns(windows: tuple[int, ...] = WINDOWS) -> list[str]:
    return BASE + [f"{m}_{n}g" for n in windows for m in ("avg_gf", "avg_ga", "avg_total", "win_pct", "std_gf")]


def feature_columns(windows: tuple[int, ...] = WINDOWS) -> list[str]:
    """Names of the model's features: 79 with the default windows."""
    sides = [f"{s}_{c}" for s in ("home", "away") for c in [*side_columns(windows), "games_played"]]
    return sides + ["h2h_avg_goals", "venue_avg_goals", *CALENDAR, *CROSS] + [f"{c}_{n}g" for n in windows for c in ("scoring_opp", "opp_threat")]


def team_features(log: DataFrame, window: int = 20, min_games: int = 5, windows: tuple[int, ...] = WINDOWS, write: bool = True) -> DataFrame:
    out = rolling.venue_rates(rolling.multi_window(rolling.rolling_means(rolling.spread(log, halo=max(2 * window, *windows), write=write), window), windows), window)
    out = rolling.own(rolling.streak(rolling.played_and_rest(out)))
    return rolling.gate(out, [*side_columns(windows), "home_win_pct", "away_win_pct"], min_games)


def join_sides(games: DataFrame, sides: DataFrame, columns: list[str]) -> DataFrame:
    """Home and away columns beside each contest, by one grouped pass over the log."""
    pick = [F.max(F.when(F.col("is_home") == h, F.col(c))).alias(f"{s}_{c}") for s, h in (("home", 1), ("away", 0)) for c in columns]
    return games.join(sides.groupBy("game_pk").agg(*pick), "game_pk", "left")


def contests(sides: DataFrame, columns: list[str], rows: int = 0) -> DataFrame:
    """The contests of a log with carry, one row each, with home and away columns: one grouped pass and no join.

    rows: how many the log has, if known; the rows that a task groups do not grow with them then.
    """
    names = sides.schema["game"].dataType.names
    flat = sides.select(*[F.col("game")[c].alias(c) for c in names], F.col("is_home").alias("__home"), *[F.col(c).alias("__" + c) for c in columns])
    pick = [F.max(F.when(F.col("__home") == h, F.col("__" + c))).alias(f"{s}_{c}") for s, h in (("home", 1), ("away", 0)) for c in columns]
    return by_rows(flat, rows, "game_pk").groupBy(*names).agg(*pick)


def interactions(df: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    c = F.col
    rest = c("home_rest_days") - c("away_rest_days")
    cols = {
        "scoring_opportunity": c("home_avg_gf") * c("away_avg_ga"), "opponent_threat": c("away_avg_gf") * c("home_avg_ga"),
        "rest_advantage": rest, "rest_advantage_capped": F.greatest(F.least(rest, F.lit(5)), F.lit(-5)),
        "form_diff": c("home_win_pct") - c("away_win_pct"), "combined_avg_total": (c("home_avg_total") + c("away_avg_total")) / 2,
    }
    for n in windows:
        cols[f"scoring_opp_{n}g"] = c(f"home_avg_gf_{n}g") * c(f"away_avg_ga_{n}g")
        cols[f"opp_threat_{n}g"] = c(f"away_avg_gf_{n}g") * c(f"home_avg_ga_{n}g")
    return df.withColumns(cols)


def add_features(games: DataFrame, window: int = 20, min_games: int = 5, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """Each contest with its features from earlier contests only."""
    placed = rolling.head_to_head(rolling.own(rolling.venue_mean(rolling.spread(games, "home_team", window), window)), window // 2)
    # The contests are written, not their log, which has each of them twice.
    held = written(placed, "placed")
    sides = team_features(tables.team_log(held, carry=True), window, min_games, windows, write=False)
    out = contests(sides, [*side_columns(windows), "games_played"], 2 * held.count())
    return interactions(out.withColumns(scalars.calendar(F.col("date"))), windows)


def cohort(games: DataFrame, seasons: list, types: list[str]) -> DataFrame:
    """The contests of the seasons and types. Taken before the features, so that no other contest is in a window."""
    return games.where(F.col("season").cast("string").isin([str(s) for s in seasons]) & F.col("game_type").isin(types))


def require_features(df: DataFrame, target: str = "total_goals") -> None:
    """An error if df has no rows, no feature, or not the target."""
    if not set(feature_columns()) & set(df.columns):
        raise ValueError("no feature columns: run add_features first")
    tables.require_columns(df, [target])


def complete_cases(df: DataFrame, features: list[str], target: str = "total_goals") -> DataFrame:
    return df.na.drop(subset=[*features, target])


def resolve_features(df: DataFrame, wanted: list[str] | None = None) -> list[str]:
    """The wanted features that are there and numeric."""
    numeric = {f.name for f in df.schema.fields if f.dataType.simpleString() in ("int", "bigint", "double", "float")}
    return [c for c in wanted or feature_columns() if c in numeric]
