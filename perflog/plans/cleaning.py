"""Read-and-clean pipelines for raw logs: the ingest steps in the
reference's order, as one lazy plan each.

Entity statistics come with the rows' numbers; row-wise steps and windows
follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perflog.functions import calendar as cal
from perflog.functions import parsing as P
from perflog.functions import ratios as R
from perflog.operators import clean as C
from perflog.operators import windows as Wn
from perflog.operators.split import Builder, bucketed, finish, numbered
from perflog.spec import LogSpec


def _in_pieces(raw: DataFrame, spec: LogSpec, numbers: list[str], minutes: str | None, season: Column | None, last_n: int, lookback: int,
               *steps: Builder, result: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Types, missing values and the window columns of ``steps``: NaN and unreadable numbers are null and take the
    entity's mean; the time is parsed; results and matchups are ``UNK`` where unknown.  All means and the deviation of points
    (after the fill) come with the table of chunks that numbers the rows, so rows move to their chunk and to their bucket only."""
    cols = {c: P.nan_to_null(P.to_double(c)) for c in numbers}
    if minutes:
        cols[minutes] = P.minutes(minutes)
        numbers = numbers + [minutes]
    df = raw.withColumn(spec.time, P.parse_date(spec.time))
    df = (df if season is None else df.where(season)).withColumns(cols)
    # missing points take the mean, so they leave the mean as it is and add nothing to the sum of squares
    spread = F.sqrt(F.var_pop("PTS") * F.count("PTS") / F.when(F.count(F.lit(1)) > 1, F.count(F.lit(1)) - 1))
    rows = numbered(C.fill_unknown(df, ["MATCHUP", spec.outcome]), spec, result, total=last_n > 0,
                    stats={"__means": F.struct(*[F.avg(c).alias(c) for c in numbers]), "__s": spread})
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.col(f"__means.{c}")) for c in numbers} | {"__m": F.col("__means.PTS")}).drop("__means")
    rows, inner = bucketed(rows, spec, lookback)
    for step in steps:
        rows = rows.withColumns(step(inner))
    return finish(rows, keep)


def _recent(df: DataFrame, last_n: int) -> DataFrame:
    """An entity's last ``last_n`` games (all for 0), by row number and total: no second sort."""
    return (df.where(F.col("__rn") > F.col("__total") - last_n) if last_n > 0 else df).drop("__rn", "__total", "__run")


def player_log_clean(raw: DataFrame, spec: LogSpec, season: Column | None = None, last_n: int = 0) -> DataFrame:
    """A4: missing values, types, matchup, minutes, advanced statistics, context, time
    features and per-entity scaling of a raw player log (text minutes, dates and NaN allowed).

    ``season``: a condition on the parsed rows, applied before anything is computed; ``last_n``: games
    kept of each entity, the newest, after all is computed."""
    df = _in_pieces(raw, spec, ["PTS", "FGM", "FGA", "FTA", "TOV"], "MIN", season, last_n, 2,
                    lambda p: {"DAYS_REST": Wn.days_rest(p, 3, True, spec.time), "GAME_NUMBER": F.col("__rn").cast("int"),
                               "PTS_AVG_3": Wn.rolling_mean("PTS", 3, p, True), "PTS_DIFF": Wn.diff("PTS", p, 1, True)}, keep=("__rn",))
    df = _recent(df, last_n).withColumns({
        "HOME": P.is_home("MATCHUP"), "OPPONENT": P.opponent("MATCHUP"),
        "TS_PCT": R.true_shooting("PTS", "FGA", "FTA", "null"), "USAGE_RATE": R.usage("FGA", "FTA", "TOV"),
        "BACK_TO_BACK": (F.col("DAYS_REST") <= 1).cast("int"), "WIN": R.win_flag(spec.outcome),
        "EARLY_SEASON": cal.season_phase(spec.time)["early_season"],
        "PTS_ZSCORE": F.when(F.col("__s") > 0, (F.col("PTS") - F.col("__m")) / F.col("__s"))})
    return df.drop("__m", "__s")


def team_log_clean(raw: DataFrame, spec: LogSpec, season: Column | None = None, last_n: int = 0) -> DataFrame:
    """A5: the same for a raw team log, with ratios and ratings, streaks and momentum."""
    df = _in_pieces(raw, spec, ["PTS", "FGM", "FGA", "FTA", "TOV", "PLUS_MINUS"], None, season, last_n, 4,
                    lambda p: {"BEFORE": Wn.prior_mean("PLUS_MINUS", 3, p, None, True), "REST": Wn.days_rest(p, 3, True, spec.time)},
                    lambda p: {"PM_TREND": Wn.momentum_of("BEFORE", p, True)}, result=spec.outcome, keep=("__run", "__rn"))
    win, loss = Wn.streaks_of_run(spec.outcome)
    df = _recent(df.withColumns({"WIN_STREAK": win, "LOSS_STREAK": loss}), last_n)
    up, down = Wn.momentum_flags("PM_TREND")
    poss = F.col("FGA") + 0.44 * F.col("FTA") + F.col("TOV")
    return df.withColumns({
        "HOME": P.is_home("MATCHUP"), "OPPONENT": P.opponent("MATCHUP"),
        "POSITIVE_MOMENTUM": up, "NEGATIVE_MOMENTUM": down, "TOV_PCT": R.safe_div(F.col("TOV"), poss, "denom_one"),
        "CLOSE_GAME": R.close_game("PLUS_MINUS"), "EXTRA_REST": (F.col("REST") >= 3).cast("int"),
        "PTS_ZSCORE": F.when(F.col("__s") > 0, (F.col("PTS") - F.col("__m")) / F.col("__s"))}).drop("__m", "__s")
