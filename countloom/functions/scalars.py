"""Row-local functions on dates, names, clocks and outcomes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def season_start(date: Column, first_month: int = 10) -> Column:
    """The year in which a date's season began."""
    return F.when(F.month(date) >= first_month, F.year(date)).otherwise(F.year(date) - 1)


def season_code(start_year: Column) -> Column:
    """20232024 for 2023."""
    return F.concat(start_year.cast("string"), (start_year + 1).cast("string"))


def code_start(code: Column) -> Column:
    """2023 for 20232024."""
    return F.substring(code, 1, 4).cast("int")


def season_dates(code: Column, first_month: int = 10, last_month: int = 6) -> tuple[Column, Column]:
    """The first and last day on which a season's contests are looked for: 1 October and 30 June."""
    start = code_start(code)
    return F.make_date(start, F.lit(first_month), F.lit(1)), F.make_date(start + 1, F.lit(last_month), F.lit(30))


def recent_seasons(date: Column, n: int, first_month: int = 10) -> Column:
    """The codes of the n seasons up to that of a date, as an array in order of time."""
    start = season_start(date, first_month)
    return F.transform(F.sequence(start - (n - 1), start), season_code)


def valid_season(code: Column) -> Column:
    ok = code.rlike("^[0-9]{8}$")
    return ok & F.when(ok, F.right(code, F.lit(4)).cast("int") == F.left(code, F.lit(4)).cast("int") + 1).otherwise(False)


def parse_day(x: Column) -> Column:
    """A date from a yyyyMMdd number (also one read as 20240105.0) or from ISO text, with a time or not; null if it is neither."""
    s = F.regexp_replace(F.trim(x.cast("string")), r"\.0$", "")
    return F.when(s.rlike(r"^\d{8}$"), F.try_to_timestamp(s, F.lit("yyyyMMdd")).cast("date")).otherwise(F.try_to_timestamp(s).cast("date"))


def clean_name(x: Column) -> Column:
    """Lower case, without dots, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"\.", ""), r"\s+", " "))


def normalize_name(x: Column, aliases: dict[str, str], abbreviations: dict[str, str]) -> Column:
    """The canonical name of an alias or an abbreviation, else the cleaned name."""
    look = lambda table, key: F.create_map(*[F.lit(v) for kv in table.items() for v in kv])[key] if table else F.lit(None).cast("string")
    return F.coalesce(look(aliases, clean_name(x)), look(abbreviations, F.upper(F.trim(x))), clean_name(x))


def duration_seconds(x: Column) -> Column:
    """Seconds of MM:SS or H:MM:SS; 0 if blank or neither."""
    p = F.split(x, ":")
    n = lambda i: F.coalesce(F.get(p, F.lit(i)).try_cast("int"), F.lit(0))
    return F.coalesce(F.when(F.size(p) == 2, n(0) * 60 + n(1)).when(F.size(p) == 3, n(0) * 3600 + n(1) * 60 + n(2)), F.lit(0))


def clock_minutes(x: Column) -> Column:
    """Minutes of MM:SS with seconds below 60, else null."""
    ok = x.rlike("^[0-9]{1,2}:[0-5][0-9]$")
    p = F.split(x, ":")
    return F.when(ok, F.get(p, F.lit(0)).try_cast("int") + F.get(p, F.lit(1)).try_cast("int") / 60.0)


def remaining_minutes(period: Column, clock: Column, state: Column) -> Column:
    """Minutes left: three periods of 20, overtime at most 5, none when finished; null on a bad clock."""
    m = clock_minutes(clock)
    left = F.when(period <= 3, m + (3 - period) * 20.0).when(period == 4, F.least(m, F.lit(5.0))).otherwise(0.0)
    return F.when(state.isin("OFF", "FINAL"), 0.0).when(m.isNotNull(), F.least(F.greatest(left, F.lit(0.0)), F.lit(60.0)))


def calendar(date: Column, first_month: int = 10) -> dict[str, Column]:
    """Month, weekday (0 Monday), weekend, days into the season and what follows from them."""
    days = F.datediff(date, F.make_date(season_start(date, first_month), F.lit(first_month), F.lit(1)))
    return {
        "month": F.month(date), "day_of_week": F.weekday(date), "is_weekend": (F.weekday(date) >= 5).cast("int"), "days_into_season": days,
        "season_progress": F.least(F.greatest(days / 180.0, F.lit(0.0)), F.lit(1.0)), "is_late_season": (days > 140).cast("int"), "is_early_season": (days < 30).cast("int"),
    }


def total_bucket(total: Column) -> Column:
    return F.when(total <= 3, "0-3").when(total <= 5, "4-5").when(total <= 7, "6-7").when(total.isNotNull(), "8+")


def rest_bucket(diff: Column) -> Column:
    return F.when(diff.isNull(), "unknown").when(diff <= -2, "away_rested").when(diff >= 2, "home_rested").otherwise("even")


def game_key(date: Column, home: Column, away: Column) -> Column:
    return F.concat_ws("|", F.date_format(date, "yyyy-MM-dd"), home, away)


def week_block(date: Column) -> Column:
    """2024-10-07/2024-10-13: the Monday and Sunday around a date."""
    monday = F.date_trunc("week", date).cast("date")
    return F.concat(F.date_format(monday, "yyyy-MM-dd"), F.lit("/"), F.date_format(F.date_add(monday, 6), "yyyy-MM-dd"))
