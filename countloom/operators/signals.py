"""Expected goals and goalies' form beside the teams' log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .rolling import CHUNK, before, own, rolling_ratio, spread

XG_KEY = ["season", "date", "team", "opponent"]


def xg_log(xg_games: DataFrame) -> DataFrame:
    """Two rows a contest with xgf and xga, from season, date, home_team, away_team, home_xg, away_xg."""
    side = lambda team, opponent, own, other: F.struct(F.col(team).alias("team"), F.col(opponent).alias("opponent"), F.col(own).alias("xgf"), F.col(other).alias("xga"))
    both = F.array(side("home_team", "away_team", "home_xg", "away_xg"), side("away_team", "home_team", "away_xg", "home_xg"))
    return xg_games.select("season", "date", F.explode(both).alias("s")).select("season", "date", "s.*")


def add_xg(log: DataFrame, xg: DataFrame, windows: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """The log with xgf and xga of its key and their means over the rows before.

    A key found twice in xg counts with its mean, so that no row of the log is doubled; rows without one have nulls.
    """
    one = xg.groupBy(*XG_KEY).agg(F.avg("xgf").alias("xgf"), F.avg("xga").alias("xga"))
    out = log.join(one, XG_KEY, "left")
    w = before(out, "team")
    return out.withColumns({f"avg_{c}_{n}g": F.avg(c).over(w.rowsBetween(-n, -1)) for n in windows for c in ("xgf", "xga")})


def match_rate(log: DataFrame) -> DataFrame:
    """The share of rows that found expected goals, in one row."""
    return log.agg((F.count("xgf") / F.count("*")).alias("match_rate"), F.count("*").alias("rows"))


def goalie_form(starters: DataFrame, side: str, window: int = 10, min_starts: int = 3, size: int = CHUNK) -> DataFrame:
    """game_pk, {side}_goalie_sv_pct and {side}_goalie_gaa over the starter's earlier starts on that side.

    starters has date and the columns of sources.games.starters. Contests
    without a starter are left out: join with "left".
    """
    key = f"{side}_goalie_id"
    held = spread(starters.where(F.col(key).isNotNull()), key, window, size, write=False)
    n = F.count("*").over(before(held, key).rowsBetween(-window, -1))
    sv = rolling_ratio(held, key, f"{side}_saves", f"{side}_shots_against", "__sv", window)
    sv = sv.withColumns({"__n": n, "__ga": F.avg(f"{side}_goals_against").over(before(held, key).rowsBetween(-window, -1))})
    enough = F.col("__n") >= min_starts
    return own(sv).select("game_pk", F.when(enough, F.col("__sv")).alias(f"{side}_goalie_sv_pct"), F.when(enough, F.col("__ga")).alias(f"{side}_goalie_gaa"))


def add_goalies(games: DataFrame, starters: DataFrame, window: int = 10, min_starts: int = 3) -> DataFrame:
    """Contests with both starters' form; those without boxscore keep nulls."""
    dated = written(starters.join(games.select("game_pk", "date"), "game_pk"), "starters")  # read for each side, and for its count
    for side in ("home", "away"):
        games = games.join(goalie_form(dated, side, window, min_starts), "game_pk", "left")
    return games


def xg_interactions(df: DataFrame, windows: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Expected goals less goals of each side, and each side's attack against the other's defence, by window.

    A window without the columns of both sides is left out, as goals are not kept for every window.
    """
    cols = {}
    for n in windows:
        for s in ("home", "away"):
            if {f"{s}_avg_xgf_{n}g", f"{s}_avg_gf_{n}g"} <= set(df.columns):
                cols[f"{s}_xg_diff_{n}g"] = F.col(f"{s}_avg_xgf_{n}g") - F.col(f"{s}_avg_gf_{n}g")
        for name, s, o in (("xg_scoring_opp", "home", "away"), ("xg_opp_threat", "away", "home")):
            if {f"{s}_avg_xgf_{n}g", f"{o}_avg_xga_{n}g"} <= set(df.columns):
                cols[f"{name}_{n}g"] = F.col(f"{s}_avg_xgf_{n}g") * F.col(f"{o}_avg_xga_{n}g")
    return df.withColumns(cols)


def goalie_interactions(df: DataFrame) -> DataFrame:
    """Each side's goalie against the other side's attack."""
    pairs = (("home", "away"), ("away", "home"))
    have = {s: o for s, o in pairs if {f"{s}_goalie_sv_pct", f"{o}_avg_gf"} <= set(df.columns)}
    return df.withColumns({f"{s}_goalie_vs_offense": F.col(f"{s}_goalie_sv_pct") * F.col(f"{o}_avg_gf") for s, o in have.items()})
