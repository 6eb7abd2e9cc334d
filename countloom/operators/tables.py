"""Unpivots, lookups, dedup and checks on contest tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import order_stats


def team_log(games: DataFrame, carry: bool = False) -> DataFrame:
    """Two rows a contest, one for each side, from one scan; an unknown result has no winner.

    With carry, the column game holds the contest itself, so that features.contests needs no join to get it back.
    """
    def side(team, opponent, gf, ga, home):
        win = F.when(F.col(gf).isNotNull() & F.col(ga).isNotNull(), (F.col(gf) > F.col(ga)).cast("double"))
        return F.struct(F.col(team).alias("team"), F.col(opponent).alias("opponent"), F.col(gf).alias("goals_for"), F.col(ga).alias("goals_against"), F.lit(home).alias("is_home"), win.alias("win"))

    both = F.array(side("home_team", "away_team", "home_score", "away_score", 1), side("away_team", "home_team", "away_score", "home_score", 0))
    game = [F.struct(*games.columns).alias("game")] if carry else []
    rows = games.select("game_pk", "season", "date", "total_goals", *game, F.explode(both).alias("s"))
    return rows.select("game_pk", "season", "date", "s.*", "total_goals", *["game" for _ in game])


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the order given."""
    at = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rn", at).where("__rn = 1").drop("__rn")


def history_first(history: DataFrame, slate: DataFrame, key: str = "game_pk") -> DataFrame:
    """Both tables; where an id is in both, the history's row."""
    both = history.withColumn("__src", F.lit(0)).unionByName(slate.withColumn("__src", F.lit(1)), allowMissingColumns=True)
    return keep_first(both, [key], ["__src"]).drop("__src")


def mask_upcoming(games: DataFrame) -> DataFrame:
    return games.withColumns({c: F.lit(None).cast("int") for c in ("home_score", "away_score", "total_goals")} | {"_is_upcoming": F.lit(True)})


def require_columns(df: DataFrame, names: list[str]) -> None:
    """An error if df lacks a column or has no row."""
    if missing := [c for c in names if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    if df.isEmpty():
        raise ValueError("no rows")


def first_existing(df: DataFrame, names: list[str], label: str) -> str:
    for c in names:
        if c in df.columns:
            return c
    raise ValueError(f"no column for {label}: {names}")


def reconcile(predictions: DataFrame, results: DataFrame) -> DataFrame:
    """actual for each prediction: by id, else by date and teams; the newest result of a key counts."""
    newest = lambda keys: keep_first(results, keys, [F.desc("load_order")])
    by_id = newest(["game_pk"]).select("game_pk", F.col("actual").alias("a1"))
    by_teams = newest(["date", "home_team", "away_team"]).select("date", "home_team", "away_team", F.col("actual").alias("a2"))
    out = predictions.join(by_id, "game_pk", "left").join(by_teams, ["date", "home_team", "away_team"], "left")
    return out.withColumn("actual", F.coalesce("a1", "a2")).drop("a1", "a2")


def latest_ledger(log: DataFrame, keys: list[str], keep_old: list[str], order: list[str]) -> DataFrame:
    """The last row written for each key; the columns in keep_old fall back to the last value that is not null.

    One grouped pass with partial aggregation, so a key's writes are never sorted in one task. Of writes
    equal in order one wins, by a hash of its plain columns.
    """
    plain = [f.name for f in log.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    at = F.struct(*order, F.xxhash64(*plain).alias("tie"))
    rest = [c for c in log.columns if c not in (*keys, *keep_old)]
    kept = [F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in keep_old]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), at).alias("row"), *kept)
    return last.select(*[F.col("row").getField(c).alias(c) if c in rest else F.col(c) for c in log.columns])


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """One digest of all rows, whatever their order: row digests are sorted and digested in a million buckets, these in
    256, and those in one. Equal rows are one entry with their number."""
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)
    level = df.select(row.alias("h")).groupBy("h").agg(F.count("*").alias("n")).select("h", F.concat("h", F.lit(":"), F.col("n").cast("string")).alias("d"))
    for digits in (5, 2, 0):
        level = level.groupBy(F.substring("h", 1, digits).alias("h")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("h", "d"))), lambda x: x.d), ","), 256).alias("d"))
    return level.select(F.col("d").alias("fingerprint"))


def fill_from(df: DataFrame, fills: dict[str, float], columns: list[str]) -> DataFrame:
    return df.na.fill({k: v for k, v in fills.items() if k in columns and v is not None}).na.fill(0.0, columns)


def medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: each column's median, null where it has no value; exact, by counts of ranges."""
    found = order_stats.select(df, {c: [0.5] for c in columns})
    row = tuple(float(found["", c][1][0]) if ("", c) in found else None for c in columns)
    return df.sparkSession.createDataFrame([row], ", ".join(f"`{c}` double" for c in columns))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def quality_report(games: DataFrame, columns: list[str], types: tuple[str, ...] = ("R", "P", "O")) -> DataFrame:
    """One row: rows, rows with a repeated id (all of them), copies of equal rows beyond the first, totals that
    are not the sum of the scores, missing dates, unknown types, nulls in the teams, first and last date, ready.

    ready: rows, and nothing critical; nulls in other columns are not.
    """
    c = F.col
    per_row = games.groupBy(*games.columns).agg(F.count("*").alias("times"))
    per_id = per_row.groupBy("game_pk").agg(
        F.sum("times").alias("n"), F.sum(c("times") - 1).alias("copies"),
        F.sum(F.when(c("home_score") + c("away_score") != c("total_goals"), c("times")).otherwise(0)).alias("bad"),
        F.sum(F.when(c("date").isNull(), c("times")).otherwise(0)).alias("undated"),
        F.sum(F.when(~F.coalesce(c("game_type").isin(*types), F.lit(False)), c("times")).otherwise(0)).alias("untyped"),
        F.sum(sum((F.when(c(x).isNull(), c("times")).otherwise(0) for x in columns), F.lit(0))).alias("nulls"), F.min("date").alias("lo"), F.max("date").alias("hi"),
    )
    total = lambda x, name: F.coalesce(F.sum(x), F.lit(0)).alias(name)
    out = per_id.agg(
        total(c("n"), "n_rows"), total(F.when(c("n") > 1, c("n")).otherwise(0), "duplicate_ids"), total(c("copies"), "duplicate_rows"), total(c("bad"), "score_mismatches"),
        total(c("undated"), "bad_dates"), total(c("untyped"), "bad_types"), F.min("lo").alias("first_date"), F.max("hi").alias("last_date"), total(c("nulls"), "null_teams"),
    )
    critical = ("duplicate_ids", "score_mismatches", "bad_dates", "bad_types")
    return out.withColumn("ready", (c("n_rows") > 0) & (sum((c(x) for x in critical), F.lit(0)) == 0))
