"""The registered queries over the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import distributions as dist
from ..functions import scalars
from ..operators import rolling, scoring, signals, tables
from ..sources.games import BOXSCORE, SCHEDULE, games_view, parse_schedule, starters
from ..sources.shared import written
from ..streaming import live
from . import features, linear, models, studies

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

GAMES = """games AS (
  SELECT CAST(o_orderkey AS BIGINT) AS game_pk, year(o_orderdate) AS season, CAST(o_orderdate AS DATE) AS date,
         hn.n_name AS home_team, an.n_name AS away_team, home_score, away_score, total_goals
  FROM orders JOIN (SELECT l_orderkey, min(l_suppkey) AS sk, count(*) FILTER (WHERE l_returnflag = 'N') AS home_score,
                           count(*) FILTER (WHERE l_returnflag <> 'N') AS away_score, count(*) AS total_goals
                    FROM lineitem GROUP BY l_orderkey) l ON o_orderkey = l_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation hn ON c_nationkey = hn.n_nationkey
  JOIN supplier ON sk = s_suppkey JOIN nation an ON s_nationkey = an.n_nationkey
  WHERE hn.n_name <> an.n_name)"""
LOG = """log AS (
  SELECT game_pk, season, date, home_team AS team, away_team AS opponent, home_score AS goals_for, away_score AS goals_against, 1 AS is_home,
         CASE WHEN home_score > away_score THEN 1.0 ELSE 0.0 END AS win, total_goals FROM games
  UNION ALL SELECT game_pk, season, date, away_team, home_team, away_score, home_score, 0,
         CASE WHEN away_score > home_score THEN 1.0 ELSE 0.0 END, total_goals FROM games)"""
ROLL = """roll AS (
  SELECT *, avg(goals_for) OVER w AS avg_gf, avg(goals_against) OVER w AS avg_ga, avg(total_goals) OVER w AS avg_total, avg(win) OVER w AS win_pct,
         count(win) OVER (PARTITION BY team ORDER BY date, game_pk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS games_played,
         date - lag(date) OVER (PARTITION BY team ORDER BY date, game_pk) AS rest_days
  FROM log WINDOW w AS (PARTITION BY team ORDER BY date, game_pk ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"""
FC = """fc AS (
  SELECT h.game_pk, h.date, h.season, h.team AS home_team, h.opponent AS away_team, (h.avg_total + a.avg_total) / 2 AS mu, h.total_goals AS y
  FROM roll h JOIN roll a USING (game_pk) WHERE h.is_home = 1 AND a.is_home = 0 AND h.games_played >= 5 AND a.games_played >= 5)"""
PMF = """pmf AS (
  SELECT game_pk, mu, y, k, p / sum(p) OVER (PARTITION BY game_pk) AS p,
         sum(p) OVER (PARTITION BY game_pk ORDER BY k) / sum(p) OVER (PARTITION BY game_pk) AS cdf
  FROM (SELECT *, exp(k * ln(mu) - mu - lgamma(k + 1)) AS p FROM fc CROSS JOIN (SELECT unnest(range(21)) AS k)))"""
WITH = f"WITH {GAMES}, {LOG}, {ROLL}, {FC}"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(x: Column | str) -> Column:
    return F.round(x if isinstance(x, Column) else F.col(x), 6)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def log_of(spark, d):
    return tables.team_log(games_view(spark, d))


def recent_means(log: DataFrame, columns: list[str], write: bool = True) -> DataFrame:
    """The log with these rolling means and games_played; null for a team with less than five contests."""
    return rolling.gate(rolling.own(rolling.played_and_rest(rolling.rolling_means(rolling.spread(log, halo=20, write=write)))), columns, 5)


def games_table(spark: SparkSession, d: str) -> DataFrame:
    """The contests, written once: for what reads them more than once."""
    return written(games_view(spark, d), "games")


def forecasts(spark: SparkSession, d: str, games: DataFrame | None = None) -> DataFrame:
    """A forecast for each contest whose teams have a history: the mean of both teams' rolling totals. games: their table, if there is one."""
    g = games_table(spark, d) if games is None else games
    j = features.contests(recent_means(tables.team_log(g, carry=True), ["avg_total"], write=False), ["avg_total"], 2 * g.count())
    return j.where("home_avg_total IS NOT NULL AND away_avg_total IS NOT NULL").select(
        "game_pk", "date", "season", "home_team", "away_team", ((F.col("home_avg_total") + F.col("away_avg_total")) / 2).alias("mu"), F.col("total_goals").alias("y")
    )


# --- windows and features -----------------------------------------------------------------------


@query(f"WITH {GAMES}, {LOG} SELECT game_pk, team, opponent, goals_for, goals_against, is_home, CAST(win AS DOUBLE) AS win, total_goals FROM log")
def team_log(spark, d):
    return log_of(spark, d).select("game_pk", "team", "opponent", F.col("goals_for").cast("long").alias("goals_for"), F.col("goals_against").cast("long").alias("goals_against"), "is_home", "win", F.col("total_goals").cast("long").alias("total_goals"))


_GATED = ", ".join(f"round(CASE WHEN {s}.games_played >= 5 THEN {s}.{c} END, 6) AS {n}_{c}" for s, n in (("h", "home"), ("a", "away")) for c in ("avg_gf", "avg_ga", "avg_total", "win_pct"))


@query(f"WITH {GAMES}, {LOG}, {ROLL} SELECT h.game_pk, {_GATED}, h.games_played AS home_games_played, a.games_played AS away_games_played FROM roll h JOIN roll a USING (game_pk) WHERE h.is_home = 1 AND a.is_home = 0")
def rolling_features(spark, d):
    cols = list(rolling.MEANS)
    g = games_table(spark, d)
    out = features.contests(recent_means(tables.team_log(g, carry=True), cols, write=False), [*cols, "games_played"], 2 * g.count())
    return rounded(out.select("game_pk", *[f"{s}_{c}" for s in ("home", "away") for c in [*cols, "games_played"]]))


_MULTI = ", ".join(f"round(avg(goals_for) OVER w{n}, 6) AS avg_gf_{n}g, round(avg(total_goals) OVER w{n}, 6) AS avg_total_{n}g, round(avg(win) OVER w{n}, 6) AS win_pct_{n}g, round(stddev_samp(goals_for) OVER w{n}, 6) AS std_gf_{n}g" for n in features.WINDOWS)
_W = ", ".join(f"w{n} AS (PARTITION BY team ORDER BY date, game_pk ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in features.WINDOWS)


@query(f"WITH {GAMES}, {LOG} SELECT game_pk, team, {_MULTI} FROM log WINDOW {_W}")
def multi_window_features(spark, d):
    return rounded(rolling.own(rolling.multi_window(rolling.spread(log_of(spark, d), halo=40))).select("game_pk", "team", *[f"{m}_{n}g" for n in features.WINDOWS for m in ("avg_gf", "avg_total", "win_pct", "std_gf")]))


@query(f"""WITH {GAMES}, {LOG}, a AS (SELECT *, coalesce(win <> lag(win) OVER w, true) AS new, row_number() OVER w AS rn FROM log WINDOW w AS (PARTITION BY team ORDER BY date, game_pk)),
b AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY team ORDER BY rn) AS island FROM a),
c AS (SELECT *, CASE WHEN win > 0 THEN 1 ELSE -1 END * row_number() OVER (PARTITION BY team, island ORDER BY rn) AS signed FROM b)
SELECT game_pk, team, CAST(date - lag(date) OVER w AS INT) AS rest_days, CAST(coalesce(date - lag(date) OVER w = 1, false) AS INT) AS is_back_to_back,
       CAST(coalesce(lag(signed) OVER w, 0) AS BIGINT) AS win_streak FROM c WINDOW w AS (PARTITION BY team ORDER BY rn)""")
def rest_and_streak(spark, d):
    out = rolling.own(rolling.streak(rolling.played_and_rest(rolling.spread(log_of(spark, d), halo=1))))
    return out.select("game_pk", "team", "rest_days", "is_back_to_back", F.col("win_streak").cast("long").alias("win_streak"))


@query(f"""WITH {GAMES}, {LOG} SELECT game_pk, team, round(coalesce(sum(win * is_home) OVER w / nullif(sum(is_home) OVER w, 0), 0.5), 6) AS home_win_pct,
round(coalesce(sum(win * (1 - is_home)) OVER w / nullif(sum(1 - is_home) OVER w, 0), 0.5), 6) AS away_win_pct FROM log WINDOW w AS (PARTITION BY team ORDER BY date, game_pk ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING)""")
def home_away_rates(spark, d):
    return rounded(rolling.own(rolling.venue_rates(rolling.spread(log_of(spark, d), halo=40))).select("game_pk", "team", "home_win_pct", "away_win_pct"))


@query(f"""WITH {GAMES} SELECT game_pk, round(avg(total_goals) OVER (PARTITION BY least(home_team, away_team), greatest(home_team, away_team) ORDER BY date, game_pk ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 6) AS h2h_avg_goals,
round(avg(total_goals) OVER (PARTITION BY home_team ORDER BY date, game_pk ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 6) AS venue_avg_goals FROM games""")
def pair_and_venue(spark, d):
    return rounded(rolling.head_to_head(rolling.own(rolling.venue_mean(rolling.spread(games_view(spark, d), "home_team", 20)))).select("game_pk", "h2h_avg_goals", "venue_avg_goals"))


@query(f"""WITH {GAMES}, s AS (SELECT *, CASE WHEN month(date) >= 10 THEN year(date) ELSE year(date) - 1 END AS sy FROM games), e AS (SELECT *, date - make_date(sy, 10, 1) AS dd FROM s)
SELECT game_pk, CAST(month(date) AS INT) AS month, CAST(isodow(date) - 1 AS INT) AS day_of_week, CAST(isodow(date) >= 6 AS INT) AS is_weekend, CAST(dd AS INT) AS days_into_season,
round(least(greatest(dd / 180.0, 0), 1), 6) AS season_progress, CAST(dd > 140 AS INT) AS is_late_season, CAST(dd < 30 AS INT) AS is_early_season,
CAST(sy AS VARCHAR) || CAST(sy + 1 AS VARCHAR) AS season_code, strftime(date_trunc('week', date), '%Y-%m-%d') || '/' || strftime(date_trunc('week', date) + INTERVAL 6 DAY, '%Y-%m-%d') AS block_key,
strftime(date, '%Y-%m-%d') || '|' || home_team || '|' || away_team AS game_key FROM e""")
def calendar_features(spark, d):
    g = games_view(spark, d)
    date = F.col("date")
    return rounded(g.select("game_pk", *[c.alias(k) for k, c in scalars.calendar(date).items()], scalars.season_code(scalars.season_start(date)).alias("season_code"), scalars.week_block(date).alias("block_key"), scalars.game_key(date, F.col("home_team"), F.col("away_team")).alias("game_key")))


_SO = ", ".join(f"round(h.avg_gf_{n}g * a.avg_ga_{n}g, 6) AS scoring_opp_{n}g, round(a.avg_gf_{n}g * h.avg_ga_{n}g, 6) AS opp_threat_{n}g" for n in features.WINDOWS)
_CROSS = """round(h.avg_gf * a.avg_ga, 6) AS scoring_opportunity, round(a.avg_gf * h.avg_ga, 6) AS opponent_threat, CAST(h.rest_days - a.rest_days AS INT) AS rest_advantage,
CAST(greatest(least(h.rest_days - a.rest_days, 5), -5) AS INT) AS rest_advantage_capped, round(h.win_pct - a.win_pct, 6) AS form_diff, round((h.avg_total + a.avg_total) / 2, 6) AS combined_avg_total"""
_PAIRS = ", ".join(f"avg(goals_for) OVER w{n} AS avg_gf_{n}g, avg(goals_against) OVER w{n} AS avg_ga_{n}g, avg(total_goals) OVER w{n} AS avg_total_{n}g, avg(win) OVER w{n} AS win_pct_{n}g, stddev_samp(goals_for) OVER w{n} AS std_gf_{n}g" for n in features.WINDOWS)


@query(f"""WITH {GAMES}, {LOG}, {ROLL}, m AS (SELECT roll.*, {_PAIRS} FROM roll WINDOW {_W})
SELECT h.game_pk, {_CROSS}, {_SO} FROM m h JOIN m a USING (game_pk) WHERE h.is_home = 1 AND a.is_home = 0 AND h.games_played >= 5 AND a.games_played >= 5""")
def interaction_features(spark, d):
    """All fourteen interactions."""
    out = features.add_features(games_view(spark, d)).where("home_games_played >= 5 AND away_games_played >= 5")
    return rounded(out.select("game_pk", *features.CROSS, *[f"{c}_{n}g" for n in features.WINDOWS for c in ("scoring_opp", "opp_threat")]))


_SIDE = [c for c in features.side_columns() if c not in ("rest_days", "is_back_to_back", "win_streak")]
_BOTH = ", ".join(
    [f"round({s}.{c}, 6) AS {n}_{c}" for s, n in (("h", "home"), ("a", "away")) for c in _SIDE]
    + [f"CAST({s}.rest_days AS INT) AS {n}_rest_days, CAST(coalesce({s}.rest_days = 1, false) AS INT) AS {n}_is_back_to_back, CAST({s}.win_streak AS BIGINT) AS {n}_win_streak, {s}.games_played AS {n}_games_played" for s, n in (("h", "home"), ("a", "away"))]
)
_CALENDAR = """CAST(month(date) AS INT) AS month, CAST(isodow(date) - 1 AS INT) AS day_of_week, CAST(isodow(date) >= 6 AS INT) AS is_weekend, CAST(dd AS INT) AS days_into_season,
round(least(greatest(dd / 180.0, 0), 1), 6) AS season_progress, CAST(dd > 140 AS INT) AS is_late_season, CAST(dd < 30 AS INT) AS is_early_season"""


@query(f"""WITH {GAMES}, {LOG}, {ROLL}, sa AS (SELECT *, coalesce(win <> lag(win) OVER w, true) AS new, row_number() OVER w AS rn FROM roll WINDOW w AS (PARTITION BY team ORDER BY date, game_pk)),
sb AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY team ORDER BY rn) AS island FROM sa), sc AS (SELECT *, CASE WHEN win > 0 THEN 1 ELSE -1 END * row_number() OVER (PARTITION BY team, island ORDER BY rn) AS signed FROM sb),
m AS (SELECT sc.*, coalesce(lag(signed) OVER (PARTITION BY team ORDER BY rn), 0) AS win_streak, {_PAIRS} FROM sc WINDOW {_W}),
g AS (SELECT *, date - make_date(CASE WHEN month(date) >= 10 THEN year(date) ELSE year(date) - 1 END, 10, 1) AS dd, avg(total_goals) OVER (PARTITION BY least(home_team, away_team), greatest(home_team, away_team) ORDER BY date, game_pk ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS h2h,
avg(total_goals) OVER (PARTITION BY home_team ORDER BY date, game_pk ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS venue FROM games)
SELECT g.game_pk, g.date, g.total_goals, {_BOTH}, round(h2h, 6) AS h2h_avg_goals, round(venue, 6) AS venue_avg_goals, {_CALENDAR.replace("date", "g.date")}, {_CROSS}, {_SO}
FROM g JOIN m h ON h.game_pk = g.game_pk AND h.is_home = 1 JOIN m a ON a.game_pk = g.game_pk AND a.is_home = 0 WHERE h.games_played >= 5 AND a.games_played >= 5 AND h2h IS NOT NULL AND venue IS NOT NULL""")
def all_features(spark, d):
    """All 79 features of the contests that have them."""
    cols = features.feature_columns()
    return rounded(features.complete_cases(features.add_features(games_view(spark, d)), cols).select("game_pk", "date", F.col("total_goals").cast("long").alias("total_goals"), *cols))


# --- quality, splits, lookups -------------------------------------------------------------------


@query(f"""WITH {GAMES}, h AS (SELECT sha256(concat_ws('|', game_pk, date, home_team, away_team, home_score, away_score)) AS h FROM games), n AS (SELECT h, count(*) AS n FROM h GROUP BY h),
b AS (SELECT substr(h, 1, 5) AS h, sha256(string_agg(h || ':' || n, ',' ORDER BY h || ':' || n)) AS d FROM n GROUP BY 1), c AS (SELECT substr(h, 1, 2) AS h, sha256(string_agg(d, ',' ORDER BY h)) AS d FROM b GROUP BY 1)
SELECT sha256(string_agg(d, ',' ORDER BY h)) AS fingerprint FROM c""")
def cohort_fingerprint(spark, d):
    return tables.fingerprint(games_view(spark, d), ["game_pk", "date", "home_team", "away_team", "home_score", "away_score"])


@query(f"WITH {GAMES}, {LOG}, {ROLL} SELECT round(median(avg_gf), 6) AS avg_gf, round(median(avg_ga), 6) AS avg_ga, round(median(rest_days), 6) AS rest_days FROM roll")
def fill_values(spark, d):
    roll = rolling.own(rolling.played_and_rest(rolling.rolling_means(rolling.spread(log_of(spark, d), halo=20))))
    return rounded(tables.medians(written(roll.select("avg_gf", "avg_ga", "rest_days"), "rolled"), ["avg_gf", "avg_ga", "rest_days"]))


@query(f"""WITH {GAMES}, i AS (SELECT game_pk, row_number() OVER (ORDER BY date, game_pk) - 1 AS idx, count(*) OVER () AS n FROM games)
SELECT game_pk, idx, idx < CAST(floor(0.8 * n) AS BIGINT) AS is_train, CASE WHEN idx < n - 5 * (n // 6) THEN -1 ELSE (idx - (n - 5 * (n // 6))) // (n // 6) END AS fold FROM i""")
def chronological_split(spark, d):
    g = models.indexed(games_view(spark, d))
    n = g.count()
    first, t = n - 5 * (n // 6), max(1, n // 6)
    return g.select("game_pk", "idx", (F.col("idx") < int(0.8 * n)).alias("is_train"), F.when(F.col("idx") < first, -1).otherwise(F.expr(f"(idx - {first}) div {t}")).alias("fold"))


@query("""WITH l AS (SELECT user_id, event_type, max(struct_pack(ts := ts, event_id := event_id, value := value)) AS s, count(*) AS n_writes FROM events GROUP BY 1, 2)
SELECT user_id, event_type, s.event_id AS event_id, round(s.value, 6) AS value FROM l""")
def ledger_latest(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_type", "ts", "event_id", "value")
    return rounded(tables.latest_ledger(ev, ["user_id", "event_type"], ["value"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value"))


@query(f"""WITH {GAMES}, p AS (SELECT CASE WHEN game_pk % 3 = 0 THEN -game_pk ELSE game_pk END AS game_pk, date, home_team, away_team FROM games),
k AS (SELECT date, home_team, away_team, arg_max(total_goals, game_pk) AS a2 FROM games GROUP BY ALL)
SELECT p.game_pk, coalesce(g.total_goals, k.a2) AS actual FROM p LEFT JOIN games g ON g.game_pk = p.game_pk LEFT JOIN k ON k.date = p.date AND k.home_team = p.home_team AND k.away_team = p.away_team""")
def reconcile_outcomes(spark, d):
    """Every third forecast lost its id and is matched by date and teams."""
    g = games_view(spark, d)
    predictions = g.select(F.when(F.col("game_pk") % 3 == 0, -F.col("game_pk")).otherwise(F.col("game_pk")).alias("game_pk"), "date", "home_team", "away_team")
    results = g.select("game_pk", "date", "home_team", "away_team", F.col("total_goals").cast("long").alias("actual"), F.col("game_pk").alias("load_order"))
    return tables.reconcile(predictions, results).select("game_pk", "actual")


@query("""SELECT event_type AS route, count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS errors, round(avg(value), 6) AS mean_latency, round(quantile_disc(new, 0.5), 6) AS p50, round(quantile_disc(new, 0.95), 6) AS p95, round(quantile_disc(new, 0.99), 6) AS p99,
round(count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS error_rate FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 1024 THEN value END AS new FROM events) GROUP BY event_type""")
def request_log(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet")
    log = ev.select(F.col("event_type").alias("route"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), F.col("value").alias("latency_ms"), "ts", F.col("event_id").alias("id"))
    return rounded(scoring.request_metrics(log))


@query(f"WITH {GAMES} SELECT game_pk, 'R' AS game_type, date, lower(home_team) AS home_team, home_score + away_score AS total_goals FROM games")
def schedule_payloads(spark, d):
    """Contests packed as schedule payloads by day and read back from the text."""
    g = games_view(spark, d)
    side = lambda s: F.struct(F.struct(F.lower(s + "_team").alias("default")).alias("placeName"), F.struct(F.lit(None).cast("string").alias("default")).alias("commonName"), F.col(s + "_score").alias("score"))
    game = F.struct(F.col("game_pk").alias("id"), F.col("season").cast("long").alias("season"), F.lit(2).alias("gameType"), F.lit("FINAL").alias("gameState"), side("home").alias("homeTeam"), side("away").alias("awayTeam"))
    days = g.groupBy("date").agg(F.collect_list(game).alias("games"))
    text = days.select(F.to_json(F.struct(F.array(F.struct(F.col("date").cast("string").alias("date"), "games")).alias("gameWeek"))).alias("raw"))
    return parse_schedule(text.select(F.from_json("raw", SCHEDULE).alias("j")).select("j.*")).select("game_pk", "game_type", "date", "home_team", F.col("total_goals").cast("long").alias("total_goals"))


@query("""SELECT event_id, CAST(event_id % 6 + 1 AS INT) AS period, lpad(CAST(event_id % 23 AS VARCHAR), 2, '0') || ':' || lpad(CAST(event_id % 61 AS VARCHAR), 2, '0') AS clock,
CASE WHEN event_id % 61 = 60 THEN NULL ELSE round(event_id % 23 + (event_id % 61) / 60.0, 6) END AS minutes,
CASE WHEN event_id % 61 = 60 THEN NULL WHEN event_id % 6 + 1 <= 3 THEN round(least(event_id % 23 + (event_id % 61) / 60.0 + (3 - (event_id % 6 + 1)) * 20, 60), 6) WHEN event_id % 6 + 1 = 4 THEN round(least(event_id % 23 + (event_id % 61) / 60.0, 5), 6) ELSE 0 END AS remaining FROM events""")
def live_clocks(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet").select("event_id", (F.col("event_id") % 6 + 1).cast("int").alias("period"), F.concat_ws(":", F.lpad((F.col("event_id") % 23).cast("string"), 2, "0"), F.lpad((F.col("event_id") % 61).cast("string"), 2, "0")).alias("clock"))
    return rounded(ev.withColumns({"minutes": scalars.clock_minutes(F.col("clock")), "remaining": scalars.remaining_minutes(F.col("period"), F.col("clock"), F.lit("LIVE"))}))


# --- distributions ------------------------------------------------------------------------------


@query(f"""{WITH}, {PMF} SELECT game_pk, round(sum(p) FILTER (WHERE k > 5.5), 6) AS over_55, round(sum(p) FILTER (WHERE k > 6.5), 6) AS over_65, min(k) FILTER (WHERE cdf >= 0.1 - 1e-12) AS q10, min(k) FILTER (WHERE cdf >= 0.9 - 1e-12) AS q90,
round(sum(power(cdf - CASE WHEN k >= y THEN 1 ELSE 0 END, 2)), 6) AS crps, round(-ln(greatest(sum(p) FILTER (WHERE k = least(y, 20)), 1e-12)), 6) AS nll, round(coalesce(sum(p) FILTER (WHERE k < least(y, 20)), 0) + 0.5 * sum(p) FILTER (WHERE k = least(y, 20)), 6) AS mid_pit FROM pmf GROUP BY game_pk""")
def poisson_distribution(spark, d):
    f = forecasts(spark, d).withColumn("pmf", dist.poisson_pmf(F.col("mu")))
    p, y = F.col("pmf"), F.col("y").cast("int")
    return rounded(f.select("game_pk", dist.prob_over(p, 5.5).alias("over_55"), dist.prob_over(p, 6.5).alias("over_65"), dist.quantile(p, 0.1 - 1e-12, 20).cast("long").alias("q10"), dist.quantile(p, 0.9 - 1e-12, 20).cast("long").alias("q90"), dist.crps(p, y, 20).alias("crps"), dist.pmf_nll(p, y).alias("nll"), dist.mid_pit(p, y).alias("mid_pit")))


@query(f"""{WITH}, u AS (SELECT *, exp(lgamma(k + 2.5) - lgamma(2.5) - lgamma(k + 1) - (k + 2.5) * ln(1 + 0.4 * mu) + k * (ln(0.4) + ln(mu))) AS nb, exp(k * ln(mu * 1.3) - mu * 1.3 - lgamma(k + 1)) AS p1, exp(k * ln(mu / 1.3) - mu / 1.3 - lgamma(k + 1)) AS p2 FROM fc CROSS JOIN (SELECT unnest(range(21)) AS k))
SELECT game_pk, round(sum(nb) FILTER (WHERE k > 6.5) / sum(nb), 6) AS nb2_over_65, round(sum(nb) FILTER (WHERE k = 0) / sum(nb), 6) AS nb2_zero, round(0.4 * sum(p1) FILTER (WHERE k > 6.5) / sum(p1) + 0.6 * sum(p2) FILTER (WHERE k > 6.5) / sum(p2), 6) AS mixture_over_65,
round(-sum(ln(nb)) FILTER (WHERE k = y), 6) AS nb2_nll, round(-sum(k * ln(mu) - mu - lgamma(k + 1)) FILTER (WHERE k = y), 6) AS poisson_nll FROM u GROUP BY game_pk""")
def other_distributions(spark, d):
    f, mu, y = forecasts(spark, d), F.col("mu"), F.col("y").cast("int")
    nb = dist.nb2_pmf(mu, 0.4)
    return rounded(f.withColumn("nb", nb).select("game_pk", dist.prob_over(F.col("nb"), 6.5).alias("nb2_over_65"), F.col("nb")[0].alias("nb2_zero"), dist.prob_over(dist.mixture_pmf(mu, 0.4, 1.3), 6.5).alias("mixture_over_65"), (-dist.nb2_logpmf(y, mu, 0.4)).alias("nb2_nll"), (-dist.poisson_logpmf(y, mu)).alias("poisson_nll")))


@query(f"""{WITH}, g AS (SELECT 0.0 AS alpha, 0 AS i UNION ALL SELECT power(10, -4 + 4.7 * i / 49.0), i + 1 FROM (SELECT unnest(range(50)) AS i)), c AS (SELECT y, round(mu, 4) AS mu, count(*) AS n FROM fc GROUP BY 1, 2)
SELECT i, round(-sum(n * CASE WHEN alpha = 0 THEN y * ln(mu) - mu - lgamma(y + 1) ELSE lgamma(y + 1 / alpha) - lgamma(1 / alpha) - lgamma(y + 1) - (y + 1 / alpha) * ln(1 + alpha * mu) + y * (ln(alpha) + ln(mu)) END) / sum(n), 5) AS nll FROM c CROSS JOIN g GROUP BY i""")
def dispersion_grid(spark, d):
    grid = [(0, 0.0)] + [(i + 1, 10 ** (-4 + 4.7 * i / 49)) for i in range(50)]
    points = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("alpha")) for i, a in grid])
    cells = forecasts(spark, d).groupBy(F.col("y").cast("int").alias("y"), F.round("mu", 4).alias("mu")).agg(F.count("*").alias("n"))
    out = cells.select("*", F.explode(points).alias("g")).groupBy("g.i").agg((-F.sum(F.col("n") * dist.nb2_logpmf(F.col("y"), F.col("mu"), F.col("g.alpha"))) / F.sum("n")).alias("nll"))
    return out.select("i", F.round("nll", 5).alias("nll"))


@query(f"""{WITH}, s AS (SELECT abs(y - mu) AS e, row_number() OVER (ORDER BY abs(y - mu)) - 1 AS k, count(*) OVER () AS n FROM fc) SELECT round(max(e), 6) AS radius, max(n) AS n FROM s WHERE k = CAST(ceil(0.9 * (n - 1)) AS BIGINT)""")
def conformal_radius(spark, d):
    return rounded(scoring.higher_quantile(forecasts(spark, d).select(F.abs(F.col("y") - F.col("mu")).alias("e")), "e", 0.9))


# --- scores and decisions -----------------------------------------------------------------------


@query(f"{WITH} SELECT season, count(*) AS n, round(avg(abs(mu - y)), 6) AS mae, round(sqrt(avg((mu - y) * (mu - y))), 6) AS rmse, round(avg(mu - y), 6) AS bias, round(corr(mu, y), 6) AS r FROM fc GROUP BY season")
def point_metrics(spark, d):
    return rounded(scoring.point_metrics(forecasts(spark, d), by=["season"]).withColumn("season", F.col("season").cast("long")))


_P = f"{WITH}, {PMF}, ov AS (SELECT game_pk, mu, y, sum(p) FILTER (WHERE k > 3.5) AS p, CAST(y > 3.5 AS INT) AS o FROM pmf GROUP BY ALL)"


@query(f"{_P} SELECT round(avg(power(p - o, 2)), 6) AS brier, round(-avg(o * ln(least(greatest(p, 1e-12), 1 - 1e-12)) + (1 - o) * ln(1 - least(greatest(p, 1e-12), 1 - 1e-12))), 6) AS log_loss, round(avg(o), 6) AS base_rate FROM ov")
def probability_scores(spark, d):
    o = over(spark, d)
    return rounded(o.agg(scoring.brier(F.col("p"), F.col("o")).alias("brier"), scoring.log_loss(F.col("p"), F.col("o")).alias("log_loss"), F.avg("o").alias("base_rate")))


def over(spark, d) -> DataFrame:
    f = forecasts(spark, d)
    return f.withColumns({"p": dist.prob_over(dist.poisson_pmf(F.col("mu")), 3.5), "o": (F.col("y") > 3.5).cast("int")})


@query(f"{_P}, b AS (SELECT *, len(list_filter([i * 0.1::DOUBLE for i in range(1, 10)], lambda e: round(p, 9) >= e)) AS bin FROM ov) SELECT CAST(bin AS INT) AS bin, round(avg(round(p, 9)), 6) AS mean_p, round(avg(o), 6) AS mean_y, count(*) AS n FROM b GROUP BY bin")
def reliability_curve(spark, d):
    return rounded(scoring.reliability(over(spark, d).withColumn("p", F.round("p", 9)), "p", "o"))


@query(f"""{WITH}, s AS (SELECT mu, y, unnest([struct_pack(segment := 'season', value := CAST(season AS VARCHAR)), struct_pack(segment := 'bucket', value := CASE WHEN y <= 3 THEN '0-3' WHEN y <= 5 THEN '4-5' WHEN y <= 7 THEN '6-7' ELSE '8+' END), struct_pack(segment := 'month', value := CAST(month(date) AS VARCHAR))]) AS s FROM fc)
SELECT s.segment AS segment, s.value AS value, count(*) AS games, round(avg(abs(mu - y)), 6) AS mae, round(sqrt(avg((mu - y) * (mu - y))), 6) AS rmse, round(avg(mu), 6) AS avg_mu, round(avg(y), 6) AS avg_y FROM s GROUP BY 1, 2""")
def segment_errors(spark, d):
    f = forecasts(spark, d).withColumns({"bucket": scalars.total_bucket(F.col("y")), "month": F.month("date")})
    return rounded(scoring.segments(f, ["season", "bucket", "month"]))


@query(f"""{WITH}, r AS (SELECT mu, game_pk, row_number() OVER (ORDER BY date, game_pk) AS rn, count(*) OVER () AS n FROM fc), ref AS (SELECT round(mu, 6) AS mu FROM r WHERE rn <= n // 2), rec AS (SELECT round(mu, 6) AS mu FROM r WHERE rn > n // 2),
e AS (SELECT list_distinct(quantile_cont(mu, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS q FROM ref), i AS (SELECT list_sort(q)[2:len(q) - 1] AS inner_ FROM e),
b AS (SELECT unnest(range(len(inner_) + 1)) AS b FROM i), fr AS (SELECT b, count(*) / sum(count(*)) OVER () AS f FROM (SELECT len(list_filter(inner_, lambda x: mu >= x)) AS b FROM ref CROSS JOIN i) GROUP BY b),
fc2 AS (SELECT b, count(*) / sum(count(*)) OVER () AS f FROM (SELECT len(list_filter(inner_, lambda x: mu >= x)) AS b FROM rec CROSS JOIN i) GROUP BY b),
j AS (SELECT greatest(coalesce(fc2.f, 0), 1e-6) AS p, greatest(coalesce(fr.f, 0), 1e-6) AS q FROM b LEFT JOIN fr USING (b) LEFT JOIN fc2 USING (b)), s AS (SELECT sum((p - q) * ln(p / q)) AS psi, count(*) AS bins FROM j)
SELECT round(psi, 6) AS psi, bins, CASE WHEN psi >= 0.25 THEN 'significant' WHEN psi >= 0.1 THEN 'moderate' ELSE 'stable' END AS status FROM s""")
def forecast_drift(spark, d):
    f = written(rolling.chronological_index(forecasts(spark, d)).select("idx", F.round("mu", 6).alias("mu")), "forecasts")
    half = f.count() // 2
    return rounded(scoring.psi(f.where(F.col("idx") < half), f.where(F.col("idx") >= half), "mu"))


@query(f"""{_P}, st AS (SELECT p - 0.5 AS edge, o, unnest([0.02, 0.05, 0.1]) AS min_edge FROM ov), w AS (SELECT *, CASE WHEN edge > 0 THEN o = 1 ELSE o = 0 END AS won FROM st WHERE abs(edge) >= min_edge)
SELECT CAST(min_edge AS DOUBLE) AS min_edge, count(*) AS bets, sum(CAST(won AS INT)) AS wins, round(avg(CAST(won AS INT)), 6) AS hit_rate, round(sum(CASE WHEN won THEN 1.0 ELSE -1.0 END), 6) AS pnl, round(sum(CASE WHEN won THEN 1.0 ELSE -1.0 END) / count(*), 6) AS roi, round(avg(abs(edge)), 6) AS mean_edge FROM w GROUP BY 1""")
def flat_stakes(spark, d):
    o = over(spark, d).select("p", F.col("o").alias("y_over"), F.lit(0.5).alias("reference_p_over"))
    return rounded(scoring.flat_stakes(o, [0.02, 0.05, 0.1], p="p"))


_CAND = f"""{WITH}, cand AS (SELECT 'team_strength' AS model, game_pk, date, mu, y FROM fc UNION ALL SELECT 'poisson_glm', game_pk, date, 4.0, y FROM fc UNION ALL SELECT 'double_poisson', game_pk, date, 0.5 * mu + 2, y FROM fc),
cp AS (SELECT model, game_pk, mu, y, k, exp(k * ln(mu) - mu - lgamma(k + 1)) AS p FROM cand CROSS JOIN (SELECT unnest(range(21)) AS k)), cn AS (SELECT *, p / sum(p) OVER g AS q, sum(p) OVER (g ORDER BY k) / sum(p) OVER g AS cdf FROM cp WINDOW g AS (PARTITION BY model, game_pk)),
per AS (SELECT model, game_pk, abs(any_value(mu) - any_value(y)) AS abs_error, sum(power(cdf - CASE WHEN k >= y THEN 1 ELSE 0 END, 2)) AS crps, -ln(greatest(sum(q) FILTER (WHERE k = least(y, 20)), 1e-12)) AS dist_nll, power(sum(q) FILTER (WHERE k > 6.5) - CASE WHEN any_value(y) > 6.5 THEN 1 ELSE 0 END, 2) AS over_brier FROM cn GROUP BY model, game_pk),
met AS (SELECT model, avg(abs_error) AS mae, avg(crps) AS crps, avg(dist_nll) AS dist_nll, avg(over_brier) AS over_brier FROM per GROUP BY model),
sc AS (SELECT m.*, 0.35 * m.mae / b.mae + 0.3 * m.crps / b.crps + 0.2 * m.dist_nll / b.dist_nll + 0.15 * m.over_brier / b.over_brier AS score FROM met m CROSS JOIN (SELECT * FROM met WHERE model = 'team_strength') b)"""


def candidate_scores(spark, d) -> DataFrame:
    """Scores of three simple forecasts: rolling means, a constant, and half-way between."""
    f = forecasts(spark, d)
    kinds = F.array(*[F.struct(F.lit(m).alias("model"), e.alias("mu")) for m, e in (("team_strength", F.col("mu")), ("poisson_glm", F.lit(4.0)), ("double_poisson", 0.5 * F.col("mu") + 2))])
    long = f.select("game_pk", "date", "home_team", "away_team", "y", F.explode(kinds).alias("m")).select("game_pk", "date", "home_team", "away_team", "y", "m.*")
    return models.score_rows(long, 0.0).drop("pmf")


@query(f"{_CAND} SELECT model, round(mae, 6) AS mae, round(crps, 6) AS crps, round(dist_nll, 6) AS dist_nll, round(over_brier, 6) AS over_brier, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score, mae, crps) AS INT) AS rank FROM sc")
def candidate_ranking(spark, d):
    return rounded(scoring.rank_candidates(scoring.weighted_score(studies.metrics_by_model(candidate_scores(spark, d)), "team_strength")))


@query()
def champion_selection(spark, d):
    """Leader against the others by block bootstrap over weeks, Holm's correction, and the simplest equivalent model."""
    return studies.champion(candidate_scores(spark, d), n_boot=5000)


@query(f"""{_CAND}, x AS (SELECT model, CASE WHEN score <= 0 THEN 0 ELSE least(1, score / 25) END AS p, row_number() OVER (ORDER BY model) AS idx FROM sc), h AS (SELECT *, row_number() OVER (ORDER BY p, idx) AS rn, count(*) OVER () AS m FROM x)
SELECT model, round(p, 6) AS p, round(max(least(1, p * (m - rn + 1))) OVER (ORDER BY rn), 6) AS p_holm FROM h""")
def holm_adjustment(spark, d):
    sc = scoring.weighted_score(studies.metrics_by_model(candidate_scores(spark, d)), "team_strength")
    t = sc.select("model", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") / 25)).alias("p"), F.row_number().over(W.orderBy("model")).alias("idx"))
    return rounded(scoring.holm(t).select("model", "p", "p_holm"))


@query(f"""{WITH}, r AS (SELECT game_pk, row_number() OVER (ORDER BY mu, game_pk) AS rn, count(*) OVER () AS n FROM (SELECT game_pk, round(mu, 6) AS mu FROM fc)) SELECT game_pk, CAST(greatest(1, ceil((rn - 1) * 10 / (n - 1))) AS INT) AS decile FROM r""")
def confidence_deciles(spark, d):
    f = rolling.chronological_index(forecasts(spark, d).select("game_pk", F.round("mu", 6).alias("mu")), "mu")
    n = max(2, f.count())
    return f.select("game_pk", F.greatest(F.lit(1), F.ceil(F.col("idx") * 10 / (n - 1))).cast("int").alias("decile"))


# --- live ---------------------------------------------------------------------------------------


@query(f"""{WITH}, s AS (SELECT f.*, home_score AS h, away_score AS a, 10.0 AS rem FROM fc f JOIN games USING (game_pk)), m AS (SELECT *, greatest(0.05, mu * rem / 60 * (1 + 0.04 * abs(h - a))) AS rest, h + a AS tot FROM s),
k AS (SELECT *, exp(k * ln(rest) - rest - lgamma(k + 1)) AS p FROM m CROSS JOIN (SELECT unnest(range(21)) AS k)), n AS (SELECT *, p / sum(p) OVER (PARTITION BY game_pk) AS q FROM k)
SELECT game_pk, round(coalesce(sum(q) FILTER (WHERE least(k + tot, 20) > 6.5), 0), 6) AS over_65, round(sum(q * least(k + tot, 20)), 6) AS mean FROM n GROUP BY game_pk""")
def live_update(spark, d):
    """Every contest as if ten minutes were left at its final score."""
    g = games_table(spark, d)
    states = g.select("game_pk", "home_score", "away_score", F.lit(3).alias("period"), F.lit("10:00").alias("clock"), F.lit("LIVE").alias("game_state"))
    out = live.score_live(states, forecasts(spark, d, g).select("game_pk", "mu"))
    mean = F.aggregate(F.transform("pmf", lambda p, k: p * k), F.lit(0.0), lambda a, x: a + x)
    return rounded(out.select("game_pk", dist.prob_over(F.col("pmf"), 6.5).alias("over_65"), mean.alias("mean")))


@query("SELECT user_id, s.event_id AS event_id, s.event_type AS event_type, round(s.value, 6) AS value FROM (SELECT user_id, max(struct_pack(ts := ts, event_id := event_id, event_type := event_type, value := value)) AS s FROM events GROUP BY user_id)")
def latest_event(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet").select("user_id", "ts", "event_id", "event_type", "value")
    return rounded(live.latest_state(ev, "user_id", ["ts", "event_id"], ["event_type", "value"]).drop("ts"))


# --- expected goals and goalies -----------------------------------------------------------------


def xg_games(spark, d) -> DataFrame:
    """Expected goals of the contests: a 25th of the quantity of each side's lines; the key may repeat."""
    q = lambda cond: F.sum(F.when(cond, F.col("l_quantity")).otherwise(0.0)) / 25
    lines = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey").agg(q(F.col("l_returnflag") == "N").alias("home_xg"), q(F.col("l_returnflag") != "N").alias("away_xg"))
    return games_view(spark, d).join(lines, F.col("game_pk") == F.col("l_orderkey")).select("season", "date", "home_team", "away_team", "home_xg", "away_xg")


XG = """xg AS (SELECT season, date, home_team, away_team, h / 25 AS home_xg, a / 25 AS away_xg FROM games JOIN (SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS h, sum(CASE WHEN l_returnflag <> 'N' THEN l_quantity ELSE 0 END) AS a FROM lineitem GROUP BY 1) ON game_pk = l_orderkey),
xl AS (SELECT season, date, team, opponent, avg(xgf) AS xgf, avg(xga) AS xga FROM (SELECT season, date, home_team AS team, away_team AS opponent, home_xg AS xgf, away_xg AS xga FROM xg UNION ALL SELECT season, date, away_team, home_team, away_xg, home_xg FROM xg) GROUP BY ALL)"""


@query(f"""WITH {GAMES}, {LOG}, {XG} SELECT game_pk, team, round(xgf, 6) AS xgf, round(xga, 6) AS xga, round(avg(xgf) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS avg_xgf_5g, round(avg(xga) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS avg_xga_5g,
round(avg(xgf) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 6) AS avg_xgf_20g, round(avg(xga) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 6) AS avg_xga_20g FROM log LEFT JOIN xl USING (season, date, team, opponent) WINDOW w AS (PARTITION BY team ORDER BY date, game_pk)""")
def xg_features(spark, d):
    out = rolling.own(signals.add_xg(rolling.spread(log_of(spark, d), halo=20), signals.xg_log(xg_games(spark, d)), (5, 20)))
    return rounded(out.select("game_pk", "team", "xgf", "xga", *[f"avg_{c}_{n}g" for n in (5, 20) for c in ("xgf", "xga")]))


@query(f"WITH {GAMES}, {LOG}, {XG} SELECT round(count(xgf) / count(*), 6) AS match_rate, count(*) AS rows FROM log LEFT JOIN xl USING (season, date, team, opponent)")
def xg_match_rate(spark, d):
    return rounded(signals.match_rate(signals.add_xg(log_of(spark, d), signals.xg_log(xg_games(spark, d)), ())))


def boxscores(spark, d) -> DataFrame:
    """Boxscore payloads: an order's lines are its goalies, by flag on either side; read back from their text."""
    saves, against = F.col("l_quantity").cast("int"), F.round(F.col("l_tax") * 100).cast("int")
    goalie = F.struct(
        F.col("l_suppkey").alias("playerId"), F.struct(F.col("l_suppkey").cast("string").alias("default")).alias("name"), (F.col("l_linenumber") == 3).alias("starter"),
        F.concat_ws(":", saves.cast("string"), F.lpad((F.col("l_linenumber") * 7).cast("string"), 2, "0")).alias("toi"), saves.alias("saves"), (saves + against).alias("shotsAgainst"), against.alias("goalsAgainst"), (saves / (saves + against)).alias("savePctg"),
    )
    line = F.struct("l_linenumber", "l_suppkey", saves.alias("s"), against.alias("a"), (F.col("l_returnflag") == "N").alias("home"), goalie.alias("g"))
    of = lambda home: F.struct(F.transform(F.filter("ls", lambda x: x.home == home), lambda x: x.g).alias("goalies"))
    games = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("ls"))
    raw = games.select(F.to_json(F.struct(F.col("l_orderkey").alias("game_pk"), F.struct(of(True).alias("homeTeam"), of(False).alias("awayTeam")).alias("playerByGameStats"))).alias("raw"))
    return raw.select(F.from_json("raw", BOXSCORE).alias("j")).select("j.*")


_SIDES = ", ".join(f"max(pid) FILTER (WHERE {c}) AS {s}_goalie_id, coalesce(max(saves) FILTER (WHERE {c}), 0) AS {s}_saves, coalesce(max(saves + ga) FILTER (WHERE {c}), 0) AS {s}_shots_against, coalesce(max(ga) FILTER (WHERE {c}), 0) AS {s}_goals_against" for s, c in (("home", "home"), ("away", "NOT home")))
STARTERS = f"""gl AS (SELECT l_orderkey AS game_pk, l_returnflag = 'N' AS home, l_linenumber AS ln, l_suppkey AS pid, CAST(trunc(l_quantity) AS INT) AS saves, CAST(round(l_tax * 100) AS INT) AS ga FROM lineitem),
gr AS (SELECT *, row_number() OVER (PARTITION BY game_pk, home ORDER BY CASE WHEN ln = 3 THEN 0 ELSE 1 END, saves * 60 + ln * 7 DESC, ln, pid, saves, ga) AS rn FROM gl WHERE ln <> 3
  UNION ALL SELECT *, row_number() OVER (PARTITION BY game_pk, home ORDER BY pid, saves, ga) FROM gl WHERE ln = 3),
gf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY game_pk, home ORDER BY CASE WHEN ln = 3 THEN 0 ELSE 1 END) AS r1 FROM gr WHERE rn = 1) WHERE r1 = 1),
st AS (SELECT game_pk, {_SIDES} FROM gf GROUP BY game_pk)"""


@query(f"WITH {STARTERS} SELECT * FROM st")
def boxscore_starters(spark, d):
    return starters(boxscores(spark, d)).select("game_pk", *[f"{s}_{c}" for s in ("home", "away") for c in ("goalie_id", "saves", "shots_against", "goals_against")])


_FORM = lambda s: f"""SELECT game_pk, round(CASE WHEN count(*) OVER w >= 3 AND sum({s}_shots_against) OVER w > 0 THEN sum({s}_saves) OVER w / sum({s}_shots_against) OVER w END, 6) AS {s}_goalie_sv_pct, round(CASE WHEN count(*) OVER w >= 3 THEN avg({s}_goals_against) OVER w END, 6) AS {s}_goalie_gaa
FROM st JOIN games USING (game_pk) WHERE {s}_goalie_id IS NOT NULL WINDOW w AS (PARTITION BY {s}_goalie_id ORDER BY date, game_pk ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"""  # noqa: E731


@query(f"WITH {GAMES}, {STARTERS} SELECT games.game_pk AS game_pk, home_goalie_sv_pct, home_goalie_gaa, away_goalie_sv_pct, away_goalie_gaa FROM games LEFT JOIN ({_FORM('home')}) h ON h.game_pk = games.game_pk LEFT JOIN ({_FORM('away')}) a ON a.game_pk = games.game_pk")
def goalie_features(spark, d):
    out = signals.add_goalies(games_table(spark, d), starters(boxscores(spark, d)))
    return rounded(out.select("game_pk", *[f"{s}_goalie_{c}" for s in ("home", "away") for c in ("sv_pct", "gaa")]))


# --- models -------------------------------------------------------------------------------------


def frame(spark, d, windows: tuple[int, ...] = features.WINDOWS) -> tuple[DataFrame, list[str]]:
    """The contests that have all features, numbered in order of time and kept as a table, and the features' names."""
    cols = features.feature_columns(windows)
    # Written before the filter, which would otherwise be planned together with all features' expressions.
    every = written(features.add_features(games_view(spark, d), windows=windows), "features")
    return written(models.indexed(features.complete_cases(every, cols)), "frame"), cols


def halves(df: DataFrame, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Training and hold-out; a date's contests are all on one side, so that training ends before the hold-out begins."""
    cut = int(share * df.count())
    day = df.where(F.col("idx") == cut).select("date").first()[0]
    return df.where(F.col("date") < day), df.where(F.col("date") >= day)


@query()
def model_holdout(spark, d):
    """Errors of five models, and of the training rows' mean, on the last fifth of the contests, fitted on the others."""
    df, cols = frame(spark, d)
    train, test = halves(df)
    fitted = studies.point_models(train, cols, boosting=models.fit_point_model)
    mean = F.lit(float(train.agg(F.avg("total_goals")).first()[0]))
    fitted["mean"] = lambda df: df.withColumn("mu", mean)
    each = [f(test).select(F.lit(k).alias("model"), "mu", F.col("total_goals").alias("y")) for k, f in fitted.items()]
    return rounded(scoring.point_metrics(reduce(DataFrame.unionByName, each), by=["model"]))


@query()
def feature_importance(spark, d):
    """Permutation importance of all features of the ridge regression on the last fifth."""
    df, cols = frame(spark, d)
    train, test = halves(df)
    line = linear.products(train, cols).ridge([0], cols)
    return rounded(studies.linear_importance(line, test.drop("idx"), cols))


@query()
def parameter_search(spark, d):
    """Forty trials of boosted trees in six parameters, by successive halving over three folds."""
    df, cols = frame(spark, d)
    found = studies.boosted_search(df, cols, models.fold_bounds(df.count(), 3))
    return found.select("trial", *[r6(F.col("params")[k]).alias(k) for k in studies.BOOSTED_SPACE], "round", r6("mae").alias("mae"), "rank")


@query()
def ablation_study(spark, d):
    """All 79 features against all but one family and against the team-strength model, over five folds."""
    df, cols = frame(spark, d, features.WINDOWS)
    return rounded(studies.ablation(df, "ridge", cols, models.fold_bounds(df.count())))


@query()
def locked_benchmark(spark, d):
    """Gate, fixed hold-out, tuning of boosted trees in 40 trials, five candidates and their champion."""
    df, cols = frame(spark, d)
    return studies.locked_benchmark(df, cols)


@query()
def team_strength_holdout(spark, d):
    """Team-strength and double-Poisson means of the last fifth of the contests, fitted on the others."""
    train, test = halves(written(models.indexed(games_view(spark, d)), "games"))
    ts = models.fit_point_model("team_strength", train, [])(test).select("game_pk", "total_goals", F.col("mu").alias("mu_team"))
    dp = models.fit_point_model("double_poisson", train, [])(test).select("game_pk", F.col("mu").alias("mu_double"))
    return rounded(ts.join(dp, "game_pk"))


@query()
def cross_validation(spark, d):
    """Fold metrics of the team-strength model under expanding-window validation."""
    g = written(models.indexed(games_view(spark, d)), "games")
    return rounded(models.fold_metrics(models.evaluate(g, "team_strength", [], models.fold_bounds(g.count(), 5))))


@query(f"""{WITH}, g AS (SELECT m, 1.05 + 0.05 * m AS mult FROM (SELECT unnest(range(16)) AS m)), c AS (SELECT y, round(mu, 4) AS mu, count(*) AS n FROM fc GROUP BY 1, 2),
p AS (SELECT m, y, c.mu, n, k, exp(k * ln(mu * mult) - mu * mult - lgamma(k + 1)) AS a, exp(k * ln(mu / mult) - mu / mult - lgamma(k + 1)) AS b FROM c CROSS JOIN g CROSS JOIN (SELECT unnest(range(21)) AS k)),
q AS (SELECT m, y, mu, any_value(n) AS n, sum(a) FILTER (WHERE k = least(y, 20)) / sum(a) AS a, sum(b) FILTER (WHERE k = least(y, 20)) / sum(b) AS b FROM p GROUP BY m, y, mu), w AS (SELECT *, unnest([1, 2, 3, 4, 5, 6, 7, 8, 9]) AS w FROM q)
SELECT CAST(w AS INT) AS weight10, CAST(m AS INT) AS multiplier, round(-sum(n * ln(greatest(w / 10.0 * a + (1 - w / 10.0) * b, 1e-12))) / sum(n), 5) AS nll FROM w GROUP BY 1, 2""")
def mixture_grid(spark, d):
    """Mean loss of the two-part Poisson mixture at all weights (in tenths) and multipliers (their number in the grid)."""
    grid = models.mixture_losses(forecasts(spark, d), models.MIXTURE_WEIGHTS, models.MIXTURE_MULTIPLIERS)
    return grid.select(F.round(F.col("weight") * 10).cast("int").alias("weight10"), F.round((F.col("multiplier") - 1.05) * 20).cast("int").alias("multiplier"), F.round("nll", 5).alias("nll"))
