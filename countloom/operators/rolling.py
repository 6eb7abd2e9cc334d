"""Windows over the contests before each one; nothing looks at the contest itself.

There are few teams, so a window by team has few tasks. spread() cuts each
history in chunks first; the functions here then work chunk by chunk and give
the same values, and own() takes the copies out again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import by_rows, written
from .numbering import number_rows

MEANS = {"avg_gf": "goals_for", "avg_ga": "goals_against", "avg_total": "total_goals", "win_pct": "win"}
#: Rows of a chunk.
CHUNK = 100_000
#: Rows before a chunk that it holds copies of: the longest frame used here.
HALO = 80


def before(df: DataFrame, *keys: str) -> W:
    """The rows of the same keys, and chunk where the table is spread, in order of time."""
    return W.partitionBy(*keys, *(c for c in ("__chunk",) if c in df.columns)).orderBy("date", "game_pk")


def spread(df: DataFrame, key: str | list[str] = "team", halo: int = HALO, size: int = CHUNK, write: bool = True) -> DataFrame:
    """df in chunks of size rows of each key's history, each with copies of the halo rows before it.

    Adds __chunk and __own (false for copies). Where no history is longer
    than size, df comes back as it is: each history is one chunk then. Else
    a count of rows by key and date says where a chunk begins: with a date, so
    that a chunk has less than twice size rows and the table is neither sorted
    nor written again. Where one date of a key has more than size rows, the rows are
    numbered by one sort over key, date and game_pk instead, and lie
    in several tasks. Null keys and dates are values of their own. No frame
    may reach back further than halo rows; a chunk may have more copies. write:
    df is written once; not needed where it is cheap to make again.
    """
    keys = [key] if isinstance(key, str) else key
    held = written(df, "log") if write else df
    longest, rows = held.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if longest <= size:
        return by_rows(held, rows, *keys)
    cells = held.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("date").alias("__date")).agg(F.count("*").alias("__n"))
    cells = written(cells, "days")  # a row for each key and date
    if cells.agg(F.max("__n")).first()[0] <= size:
        return by_rows(_by_days(held, cells, keys, halo, size), rows, *keys, "__chunk")
    placed = number_rows(held, [*keys, "date", "game_pk"], "__at", nulls_first=True)  # as windows order
    first = written(placed.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.min("__at").alias("__first")), "first")
    on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    at = F.col("__at") - F.col("__first")
    home, last = F.floor(at / size), F.floor((at + halo) / size)
    chunks = placed.join(first, on).select(*df.columns, home.alias("__home"), F.explode(F.sequence(home, last)).alias("__chunk"))
    return by_rows(chunks.withColumn("__own", F.col("__home") == F.col("__chunk")).drop("__home"), rows, *keys, "__chunk")


def _by_days(df: DataFrame, cells: DataFrame, keys: list[str], halo: int, size: int) -> DataFrame:
    """spread() by whole dates; cells has the rows (__n) of each key (__k0, ...) and __date, size at most."""
    past = W.partitionBy(*[f"__k{i}" for i in range(len(keys))]).orderBy(F.col("__date").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    first = F.coalesce(F.sum("__n").over(past), F.lit(0))
    placed = cells.withColumn("__first", first).withColumns({"__home": F.floor(F.col("__first") / size), "__last": F.floor((F.col("__first") + F.col("__n") + halo) / size)})
    placed = written(placed.drop("__n", "__first"), "chunks")
    on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]) & F.col("date").eqNullSafe(F.col("__date"))
    chunks = df.join(placed, on).select(*df.columns, "__home", F.explode(F.sequence("__home", "__last")).alias("__chunk"))
    return chunks.withColumn("__own", F.col("__home") == F.col("__chunk")).drop("__home")


def own(df: DataFrame) -> DataFrame:
    """A spread table's rows, each once."""
    return df.where("__own").drop("__chunk", "__own") if "__own" in df.columns else df


def _known(df: DataFrame) -> Column:
    """The outcome, null in copies: what is counted from the beginning must count a row once."""
    return F.when(F.col("__own"), F.col("win")) if "__own" in df.columns else F.col("win")


def _carry(df: DataFrame, sums: DataFrame, columns: list[str]) -> DataFrame:
    """df with columns of its team and chunk; sums has a row for each, so df, which is wide by then, is not shuffled for it."""
    small = F.broadcast(sums.select(F.col("team").alias("__t"), F.col("__chunk").alias("__c"), *columns))
    return df.join(small, F.col("team").eqNullSafe(F.col("__t")) & (F.col("__chunk") == F.col("__c"))).drop("__t", "__c")


def rolling_means(log: DataFrame, window: int = 20, suffix: str = "") -> DataFrame:
    w = before(log, "team").rowsBetween(-window, -1)
    return log.withColumns({k + suffix: F.avg(c).over(w) for k, c in MEANS.items()})


def multi_window(log: DataFrame, windows: tuple[int, ...] = (5, 10, 20, 40)) -> DataFrame:
    """Means and the sample deviation of goals_for; all frames share one exchange and sort."""
    cols: dict[str, Column] = {}
    for n in windows:
        w = before(log, "team").rowsBetween(-n, -1)
        cols |= {f"{k}_{n}g": F.avg(c).over(w) for k, c in MEANS.items()} | {f"std_gf_{n}g": F.stddev_samp("goals_for").over(w)}
    return log.withColumns(cols)


def played_and_rest(log: DataFrame) -> DataFrame:
    w = before(log, "team")
    out = log.withColumns({"games_played": F.count(_known(log)).over(w.rowsBetween(W.unboundedPreceding, -1)), "rest_days": F.datediff("date", F.lag("date", 1).over(w))})
    if "__chunk" in log.columns:
        of = log.groupBy("team", "__chunk").agg(F.count(_known(log)).alias("__n"))
        earlier = F.coalesce(F.sum("__n").over(W.partitionBy("team").orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        out = _carry(out, of.withColumn("__before", earlier), ["__before"])
        out = out.withColumn("games_played", F.col("games_played") + F.col("__before")).drop("__before")
    return out.withColumn("is_back_to_back", F.coalesce(F.col("rest_days") == 1, F.lit(False)).cast("int"))


def _runs(log: DataFrame) -> DataFrame:
    """__signed: the run of equal known outcomes up to each row, below zero for defeats; __island: the number of its run."""
    w, win = before(log, "team"), _known(log)
    last_known = F.last(win, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    out = log.withColumn("__new", F.when(win.isNotNull() & ~win.eqNullSafe(last_known), 1).otherwise(0))
    out = out.withColumn("__island", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    run = F.count(win).over(before(log, "team", "__island").rowsBetween(W.unboundedPreceding, W.currentRow))
    return out.withColumn("__signed", F.when(win.isNotNull(), F.when(win > 0, run).otherwise(-run))).drop("__new")


def _runs_before(log: DataFrame) -> DataFrame:
    """team, __chunk, __run: the run that the chunks before end with, 0 without one."""
    ends = _runs(log).groupBy("team", "__chunk").agg(F.max_by("__signed", F.when(F.col("__signed").isNotNull(), F.struct("date", "game_pk"))).alias("tail"), F.count(_known(log)).alias("n"))
    w = W.partitionBy("team").orderBy("__chunk")
    past = w.rowsBetween(W.unboundedPreceding, -1)
    same = (F.abs("tail") == F.col("n")) & (F.signum("tail") == F.signum(F.last("tail", ignorenulls=True).over(past)))
    # A chunk with one outcome only goes on with the run before it; any other one begins anew.
    ends = ends.withColumn("anew", F.when(F.col("tail").isNotNull() & ~F.coalesce(same, F.lit(False)), 1).otherwise(0))
    ends = ends.withColumn("part", F.sum("anew").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    ends = ends.withColumn("end", F.sum("tail").over(W.partitionBy("team", "part").orderBy("__chunk").rowsBetween(W.unboundedPreceding, W.currentRow)))
    return ends.select("team", "__chunk", F.coalesce(F.last("end", ignorenulls=True).over(past), F.lit(0)).alias("__run"))


def streak(log: DataFrame) -> DataFrame:
    """Signed run of known outcomes before each contest; an unknown one changes nothing."""
    out = _runs(log)
    past = before(log, "team").rowsBetween(W.unboundedPreceding, -1)
    prior = F.last("__signed", ignorenulls=True).over(past)
    if "__chunk" not in log.columns:
        return out.withColumn("win_streak", F.coalesce(prior, F.lit(0))).drop("__island", "__signed")
    first = F.last(F.when(F.col("__signed").isNotNull(), F.col("__island")), ignorenulls=True).over(past) == 1
    out = _carry(out.withColumns({"__prior": prior, "__first": first}), _runs_before(log), ["__run"])
    goes_on = F.col("__first") & (F.signum("__prior") == F.signum("__run"))
    run = F.coalesce(F.when(goes_on, F.col("__prior") + F.col("__run")).otherwise(F.col("__prior")), F.col("__run"))
    return out.withColumn("win_streak", run).drop("__island", "__signed", "__prior", "__first", "__run")


def venue_rates(log: DataFrame, window: int = 20) -> DataFrame:
    """Win rate at home and away over 2 * window contests; 0.5 without any. Unknown results count below, not above."""
    w = before(log, "team").rowsBetween(-2 * window, -1)
    cols = {}
    for name, flag in (("home", F.col("is_home")), ("away", 1 - F.col("is_home"))):
        den = F.sum(flag).over(w)
        cols[f"{name}_win_pct"] = F.when(den > 0, F.coalesce(F.sum(F.col("win") * flag).over(w), F.lit(0.0)) / den).otherwise(0.5)
    return log.withColumns(cols)


def head_to_head(games: DataFrame, window: int = 10, size: int = CHUNK) -> DataFrame:
    """The mean total of the same two teams' contests before."""
    paired = games.withColumns({"__a": F.least("home_team", "away_team"), "__b": F.greatest("home_team", "away_team")})
    held = spread(paired, ["__a", "__b"], window, size)
    w = before(held, "__a", "__b").rowsBetween(-window, -1)
    return own(held.withColumn("h2h_avg_goals", F.avg("total_goals").over(w))).drop("__a", "__b")


def venue_mean(games: DataFrame, window: int = 20) -> DataFrame:
    return games.withColumn("venue_avg_goals", F.avg("total_goals").over(before(games, "home_team").rowsBetween(-window, -1)))


def rolling_ratio(df: DataFrame, key: str, num: str, den: str, out: str, window: int = 10) -> DataFrame:
    """Ratio of rolling sums, as save percentage is of saves and shots."""
    w = before(df, key).rowsBetween(-window, -1)
    d = F.sum(den).over(w)
    return df.withColumn(out, F.sum(num).over(w) / F.when(d > 0, d))


def gate(df: DataFrame, columns: list[str], min_games: int, played: str = "games_played") -> DataFrame:
    return df.withColumns({c: F.when(F.col(played) >= min_games, F.col(c)) for c in columns})


def chronological_index(df: DataFrame, date: str = "date", key: str = "game_pk", out: str = "idx") -> DataFrame:
    """0-based position by date and key; rows of one date, or with one value, may be any number."""
    return number_rows(df, [date, key], out)
