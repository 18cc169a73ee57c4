"""Leakage-aware training sets (SURVEY Appendix A), as compositions of the
window, aggregate and lookup operators, with all windows in pieces (operators.split).

Each builder takes a box-score shaped log plus its ``LogSpec`` and returns one
lazy DataFrame: entity key, time keys, features (fixed schema) and target.  Measures
travel as one struct column, and so do the features until the last step: Catalyst's constraint
inference takes minutes on joins over dozens of derived columns, and seconds over a few.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perflog.functions import calendar as cal
from perflog.functions import parsing as P
from perflog.functions import ratios as R
from perflog.operators import windows as Wn
from perflog.operators.aggregates import KEY_STATS, SHOOTING, season_means
from perflog.operators.seasons import season_lag_features
from perflog.operators.split import CHUNK_SECONDS, ROWS_PER_BUCKET, cuts_of, large_entities, placed, running_means
from perflog.spec import LogSpec

# The stats averaged for the team-win set, in the reference's order.
TEAM_STATS = ["PTS", "FGM", "FGA", "FG3M", "FG3A", "FTM", "FTA", "AST", "REB", "STL", "BLK", "TOV",
              "PLUS_MINUS"]
TEAM_FEATURE_STATS = ["WIN_STREAK", "WIN_PCT", "PTS_AVG", "FGM_AVG", "FG3M_AVG", "AST_AVG", "REB_AVG",
                      "STL_AVG", "BLK_AVG", "TOV_AVG", "PLUS_MINUS_AVG"]
TEAM_TAIL = ["PREV_GAME_WIN", "WON_1_AGO", "WON_2_AGO", "WON_3_AGO", "HOME", "DAYS_REST",
             "BACK_TO_BACK", "GAME_NUMBER", "TS_PCT", "BLOWOUT_WIN", "CLOSE_GAME"]
WINDOWS = (3, 5, 10)


def team_win_features() -> list[str]:
    return [f"{s}_{n}" for n in WINDOWS for s in TEAM_FEATURE_STATS] + TEAM_TAIL


def _packed(df: DataFrame, spec: LogSpec, measures: list[str]) -> DataFrame:
    """Keys and one struct ``__m`` of the measures."""
    return df.select(spec.entity, spec.time, *spec.tie, F.struct(*measures).alias("__m"))


def _unpacked(df: DataFrame, spec: LogSpec, names: list[str], entity: str | None = None) -> DataFrame:
    return df.select(F.col(entity or spec.entity).alias(spec.entity), spec.time, *spec.tie, *[F.col(f"__f.{c}").alias(c) for c in names])


def _whole(names: list[str]) -> Column:
    """No null among the fields ``names`` of ``__f``."""
    whole = F.lit(True)
    for c in names:
        whole = whole & F.col(f"__f.{c}").isNotNull()
    return whole


def _kept(make: Callable[[DataFrame], DataFrame], log: DataFrame, spec: LogSpec, large: DataFrame, min_rows: int) -> DataFrame:
    """The rows that ``make`` gives of entities that keep ``min_rows`` of them.

    ``make`` gives complete rows in their buckets.  An entity that isn't large is one bucket, so its rows are
    counted where they are; of large ones (at most one for a bucket's number of rows of the log) the rows are made twice and counted by entity."""
    left = make(log.join(F.broadcast(large), F.col(spec.entity).eqNullSafe(F.col("__k")), "left_semi"))
    left = left.groupBy(F.col("__e").alias("__k")).agg(F.count(F.lit(1)).alias("__left"))
    rows = make(log).withColumn("__mine", F.count(F.lit(1)).over(Window.partitionBy("__e", "__bucket")))
    rows = rows.join(F.broadcast(left), F.col("__e").eqNullSafe(F.col("__k")), "left")
    return rows.where(F.coalesce("__left", "__mine") >= min_rows)


def team_win_set(log: DataFrame, spec: LogSpec, min_rows: int = 10, chunk_seconds: int = CHUNK_SECONDS,
                 rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Team-win training set: rolling form (current game included, as in the
    reference), lagged outcomes, context flags; the first
    ``max(10, floor(0.1 n))`` games of each team are trimmed and teams with
    fewer than ``min_rows`` remaining rows are dropped.  Target ``WIN``."""
    stats = [x.removesuffix("_AVG") for x in TEAM_FEATURE_STATS if x.endswith("_AVG")]
    df = log.withColumns({"WIN": R.win_flag(spec.outcome), "HOME": P.is_home("MATCHUP")})
    raw = list(dict.fromkeys([*stats, "PTS", "FGA", "FTA", "PLUS_MINUS", "HOME", "WIN"]))
    df = df.select(spec.entity, spec.time, *spec.tie, *raw)
    same_game = ["HOME", "TS_PCT", "BLOWOUT_WIN", "CLOSE_GAME", "WIN"]
    names = team_win_features() + ["WIN"]
    large = large_entities(df, spec, rows_per_bucket)
    cuts = cuts_of(df, spec, large, max(WINDOWS), chunk_seconds, rows_per_bucket)

    def make(log: DataFrame) -> DataFrame:
        rows, p = placed(log, spec, cuts, chunk_seconds)
        # what follows from a row's own numbers is made where the row has come to
        rows = rows.withColumns({"TS_PCT": R.true_shooting("PTS", "FGA", "FTA", "zero"), "BLOWOUT_WIN": R.blowout_win("PLUS_MINUS", "WIN"),
                                 "CLOSE_GAME": R.close_game("PLUS_MINUS")})
        rows = rows.select("__e", spec.time, *spec.tie, "__bucket", "__halo", "__rn", "__total", F.struct(*stats, *same_game).alias("__m"))
        rows = rows.withColumns(Wn.last_values("__m", max(WINDOWS), p, True) | {"DAYS_REST": Wn.days_rest(p, 3, True, spec.time)})
        cols = {"GAME_NUMBER": F.col("__rn").cast("int"), "DAYS_REST": F.col("DAYS_REST"), "BACK_TO_BACK": (F.col("DAYS_REST") < 2).cast("int")}
        for n in WINDOWS:
            cols[f"WIN_STREAK_{n}"] = Wn.sum_of_last("__m", "WIN", n)
            cols[f"WIN_PCT_{n}"] = Wn.mean_of_last("__m", "WIN", n)
            cols |= {f"{st}_AVG_{n}": Wn.mean_of_last("__m", st, n) for st in stats}
        cols |= {name: F.coalesce(F.col(f"__l{k}.WIN"), F.lit(0)).cast("int") for name, k in
                 (("PREV_GAME_WIN", 1), ("WON_1_AGO", 1), ("WON_2_AGO", 2), ("WON_3_AGO", 3))}
        cols |= {c: F.col(f"__m.{c}") for c in same_game}
        rows = rows.where(~F.col("__halo") & (F.col("__rn") > F.greatest(F.lit(10), F.floor(F.col("__total") * 0.1))))
        rows = rows.withColumn("__f", F.struct(*[cols[c].alias(c) for c in names])).where(_whole(names))
        return rows.select("__e", "__bucket", spec.time, *spec.tie, "__f")

    return _unpacked(_kept(make, df, spec, large, min_rows), spec, names, "__e")


def season_set(log: DataFrame, spec: LogSpec, target: str = "PTS") -> DataFrame:
    """Season training set: per-season means (E1/E2), then lag features
    (D20/D21) with the season's own mean as target (F5)."""
    lab = cal.season_label_from_date(spec.time)
    seasons = season_means(log.withColumn("SEASON_YEAR", lab), [spec.entity], "SEASON_YEAR")
    stats = [c for c in KEY_STATS if c in seasons.columns] + [n for n, _, _ in SHOOTING]
    return season_lag_features(seasons, spec.entity, "SEASON_YEAR", stats, target)


def career_set(log: DataFrame, spec: LogSpec, target: str = "PTS", min_rows: int = 10, **pieces) -> DataFrame:
    """Career training set: expanding means of every key stat except the
    target, games so far; entities with fewer than ``min_rows`` rows dropped."""
    stats = [st for st in KEY_STATS if st in log.columns and st != target]
    rows = log.select(spec.entity, spec.time, *spec.tie, F.col(target).alias("__t"), F.struct(*stats).alias("__m"))
    rows = running_means(rows, spec, {f"CAREER_{st}_AVG": f"__m.{st}" for st in stats}, whole="__t", **pieces).drop("__m")
    number = F.col("__rn").cast("int")
    cols = {"CAREER_GAMES": number} | {f"CAREER_{st}_AVG": F.col(f"CAREER_{st}_AVG") for st in stats} | {
        "GAME_NUMBER": number, "TARGET": F.col("__t")}
    rows = rows.withColumn("__f", F.struct(*[c.alias(n) for n, c in cols.items()]))
    return _unpacked(rows.where(_whole(list(cols)) & (F.col("__whole") >= min_rows)), spec, list(cols))


def player_game_stats(log: DataFrame, target: str) -> list[str]:
    return [st for st in KEY_STATS if st != target and st != "MIN" and st in log.columns]


def player_game_names(stats: list[str], target: str, opponents: list[str] = ()) -> list[str]:
    """Feature names of the player-game set, in order; ``opponents``: one-hots of a fixed list."""
    names = [f"{target}_{k}_{n}" for n in WINDOWS for k in ("AVG", "STD", "EMA")]
    names += [y for x in ("TS_PCT", "USAGE_RATE") for y in (x, f"{x}_AVG_5", f"{x}_AVG_10")]
    names += ["HOME", "DAYS_REST", "NO_REST", "SHORT_REST", "NORMAL_REST", "EXTENDED_REST", "BACK_TO_BACK",
              "EARLY_SEASON", "MID_SEASON", "LATE_SEASON", "OPP_STRENGTH"]
    return names + [f"OPP_{o}" for o in opponents] + ["MIN"] + [f"{st}_AVG_{n}" for st in stats for n in (5, 10)]


def player_game_set(log: DataFrame, spec: LogSpec, strength: DataFrame | None = None, target: str = "PTS", min_rows: int = 3,
                    chunk_seconds: int = CHUNK_SECONDS, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Player-game set before selection and scaling (:mod:`perflog.models.chain` fits those): target rolling mean / std / EWM,
    TS% and usage with their averages, rest, home, phase, opponent strength (default 3), the game's minutes and other
    key stats' averages; ``OPPONENT`` for the one-hots; ``TARGET``.  Windows that are not full take the entity's mean (a
    deviation: its deviation).  Rows with a null go, and then entities of fewer than ``min_rows`` rows (B11, B12)."""
    from perflog.operators.lookups import lookup_default
    s = spec
    stats = player_game_stats(log, target)
    rates = ["TS_PCT", "USAGE_RATE"]
    raw = list(dict.fromkeys([target, "MIN", "PTS", "FGA", "FTA", "TOV", *stats]))
    df = log.withColumns({"HOME": P.is_home("MATCHUP"), "OPPONENT": P.opponent_last_token("MATCHUP")})
    df = df.select(s.entity, s.time, *s.tie, "OPPONENT", "HOME", *raw)
    derived = {"TS_PCT": R.true_shooting("PTS", "FGA", "FTA", "zero"), "USAGE_RATE": R.usage("FGA", "FTA", "TOV", negative_to_zero=True),
               "TARGET": F.col(target).cast("double")}
    own = ["TARGET", "MIN", "HOME", *rates, *stats]
    # what is filled from the entity is null for all its rows or none, so the rows that will be complete can be counted beforehand
    needed = ["TARGET", "MIN", "HOME", *rates]
    whole = F.lit(True)
    for c in needed:
        whole = whole & F.col(f"__m.{c}").isNotNull()
    of_entity = {x: F.avg(f"__m.{x}") for x in ["TARGET", *rates, *stats]} | {"STD": F.stddev_samp("__m.TARGET"), "LEFT": F.count(F.when(whole, 1))}
    spans = {f"__ema_{n}": n for n in WINDOWS}
    back = max(max(WINDOWS), *[Wn.ewm_horizon(n) for n in WINDOWS])
    large = large_entities(df, s, rows_per_bucket)
    rows, p = placed(df, s, cuts_of(df, s, large, back, chunk_seconds, rows_per_bucket), chunk_seconds)

    def packed(rows: DataFrame, *more: str) -> DataFrame:
        return rows.withColumns(derived).select(*more, F.struct(*own).alias("__m"))

    # what follows from a row's own numbers is made where the row has come to
    rows = packed(rows, "__e", s.time, *s.tie, "OPPONENT", "__bucket", "__halo", "__at")
    rows, p = Wn.ewm_placed(rows.withColumn("__y", F.col("__m.TARGET")), "__y", spans, p)
    rows = rows.drop("__y").withColumn("__ema", F.struct(*spans)).drop(*spans)
    spread = {f"STD_{n}": Wn.rolling_std(F.col("__m.TARGET"), n, p, True) for n in WINDOWS}
    everything = p.rows(Window.unboundedPreceding, Window.unboundedFollowing, True)
    rows = rows.withColumns(Wn.last_values("__m", max(WINDOWS), p, True) | {"__rest": Wn.days_rest(p, 3, True, s.time)}
                            | {f"__s_{k}": c.over(everything) for k, c in of_entity.items()}
                            | {f"__d_{k}": c for k, c in spread.items()})
    rows = rows.withColumns({"__std": F.struct(*[F.col(f"__d_{k}").alias(k) for k in spread]), "__e_m": F.struct(*[F.col(f"__s_{k}").alias(k) for k in of_entity])})
    rows = rows.where(~F.col("__halo")).drop("__halo", "__bucket", "__block", "__at", *[f"__d_{k}" for k in spread], *[f"__s_{k}" for k in of_entity])
    # an entity that isn't large is one bucket, which tells its means; those of the others are a short table
    means = packed(df.join(F.broadcast(large), F.col(s.entity).eqNullSafe(F.col("__k")), "left_semi"), s.entity).groupBy(F.col(s.entity).alias("__k")).agg(
        F.struct(*[c.alias(k) for k, c in of_entity.items()]).alias("__e_l"))
    rows = rows.join(F.broadcast(means), F.col("__e").eqNullSafe(F.col("__k")), "left")
    rows = rows.withColumn("__e_m", F.coalesce("__e_l", "__e_m")).drop("__k", "__e_l")
    rows = rows.where(F.col("__e_m.LEFT") >= min_rows)
    for c in of_entity:
        rows = rows.where(F.col(f"__e_m.{c}").isNotNull())
    rest = F.col("__rest")
    cols = {}
    for n in WINDOWS:
        cols |= {f"{target}_AVG_{n}": F.coalesce(Wn.mean_of_last("__m", "TARGET", n), F.col("__e_m.TARGET")),
                 f"{target}_STD_{n}": F.coalesce(F.col(f"__std.STD_{n}"), F.col("__e_m.STD")),
                 f"{target}_EMA_{n}": F.coalesce(F.col(f"__ema.__ema_{n}"), F.col("__e_m.TARGET"))}
    for n in (5, 10):
        cols |= {f"{x}_AVG_{n}": F.coalesce(Wn.mean_of_last("__m", x, n), F.col(f"__e_m.{x}")) for x in (*rates, *stats)}
    cols |= {x: F.col(f"__m.{x}") for x in (*rates, "HOME", "MIN", "TARGET")} | {"DAYS_REST": rest}
    cols |= {k.upper(): v for k, v in cal.rest_flags(rest).items() if k != "rest_bucket"}
    cols |= {k.upper(): v for k, v in cal.season_phase(s.time).items() if k != "month"}
    names = [*player_game_names(stats, target), "TARGET"]
    made = [c for c in names if c != "OPP_STRENGTH"]
    rows = rows.withColumn("__f", F.struct(*[cols[c].alias(c) for c in made], "OPPONENT"))
    # an unknown opponent is no missing feature: it has the default strength, and its one-hots are all zero
    for c in needed:
        rows = rows.where(F.col(f"__f.{c}").isNotNull())
    rows = rows.select("__e", s.time, *s.tie, "__f", F.col("__f.OPPONENT").alias("OPPONENT"))
    if strength is not None:
        rows = lookup_default(rows, strength, "OPPONENT", "abbreviation", "strength", 3, out="OPP_STRENGTH")
    else:
        rows = rows.withColumn("OPP_STRENGTH", F.lit(3))
    return rows.select(F.col("__e").alias(s.entity), s.time, *s.tie, *[F.col(c if c == "OPP_STRENGTH" else f"__f.{c}").alias(c) for c in names], "OPPONENT")


def next_game_row(log: DataFrame, spec: LogSpec, requests: DataFrame, opponents: list[str], strength: DataFrame | None = None,
                  target: str = "PTS") -> DataFrame:
    """One scoring row per request (entity, GAME_DATE, OPPONENT, IS_HOME) from the entity's
    averages so far: every ``_AVG_`` and ``_EMA_`` is the average, every ``_STD_`` a tenth of it; rest since the
    last game (3 without one), home, phase, opponent strength and one-hots; TS% and usage of the
    averages.  Entities without games give no row."""
    from perflog.operators.lookups import lookup_default
    s = spec
    stats = player_game_stats(log, target)
    used = list(dict.fromkeys([target, "MIN", "PTS", "FGA", "FTA", "TOV", *stats]))
    avg = log.groupBy(F.col(s.entity).alias("__k")).agg(*[F.avg(c).alias(f"__{c}") for c in used], F.max(s.time).alias("__last"))
    df = requests.join(avg, F.col(s.entity) == F.col("__k")).drop("__k")
    if strength is not None:
        df = lookup_default(df, strength, "OPPONENT", "abbreviation", "strength", 3, out="OPP_STRENGTH")
    else:
        df = df.withColumn("OPP_STRENGTH", F.lit(3))
    df = df.withColumns({"TS_PCT": R.true_shooting("__PTS", "__FGA", "__FTA", "zero"),
                         "USAGE_RATE": R.usage("__FGA", "__FTA", "__TOV", negative_to_zero=True),
                         "HOME": F.coalesce(F.col("IS_HOME").cast("int"), F.lit(0)), "MIN": F.col("__MIN"),
                         "DAYS_REST": F.coalesce(F.timestamp_diff("DAY", F.col("__last"), F.col("GAME_DATE")), F.lit(3)).cast("int")})
    cols = {f"{target}_{k}_{n}": F.col(f"__{target}") * (0.1 if k == "STD" else 1.0) for k in ("AVG", "STD", "EMA") for n in WINDOWS}
    cols |= {f"{x}_AVG_{n}": F.col(x) for x in ("TS_PCT", "USAGE_RATE") for n in (5, 10)}
    cols |= {f"{st}_AVG_{n}": F.col(f"__{st}") for st in stats for n in (5, 10)}
    cols |= {k.upper(): v for k, v in cal.rest_flags(F.col("DAYS_REST")).items() if k != "rest_bucket"}
    cols |= {k.upper(): v for k, v in cal.season_phase("GAME_DATE").items() if k != "month"}
    cols |= {f"OPP_{o}": F.coalesce((F.col("OPPONENT") == o).cast("int"), F.lit(0)) for o in opponents}
    df = df.withColumns(cols)
    return df.select(s.entity, "GAME_DATE", "OPPONENT", *player_game_names(stats, target, opponents))
