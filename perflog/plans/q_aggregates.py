"""Aggregate, season and training-set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from perflog.functions import calendar as cal
from perflog.functions import ratios as R
from perflog.operators.aggregates import KEY_STATS, SHOOTING, distinct_values, season_means, season_shooting
from perflog.operators.seasons import season_lag_features
from perflog.plans import training as TR
from perflog.plans.bindings import BOX, BOX_SQL, ORDERS, box_scores, orders_log
from perflog.plans.registry import register
from perflog.plans.sqlbits import R4, W_LI, roll_avg, roll_sum
from perflog.session import for_wide_rows

_LABEL_SQL = ("concat(cast(case when month(l_shipdate) >= 10 then year(l_shipdate) else year(l_shipdate) - 1 end"
              " as varchar), '-', lpad(cast((case when month(l_shipdate) >= 10 then year(l_shipdate) "
              "else year(l_shipdate) - 1 end + 1) % 100 as varchar), 2, '0'))")
_RATIO_SQL = {n: f"case when {a} > 0 then {m} / {a} else 0.0 end" for n, m, a in SHOOTING}


def _boxed_seasons(spark, sf_dir):
    return box_scores(spark, sf_dir).withColumn("SEASON_YEAR", cal.season_label_from_date("l_shipdate"))


# ----------------------------------------------------------------- season_means
@register("season_means", "E1 E2", f"""
with b as ({BOX_SQL}), c as (select *, {_LABEL_SQL} as SEASON_YEAR from b)
select l_suppkey, SEASON_YEAR, count(*) as GAMES_PLAYED,
  {', '.join(f"{R4(f'avg({s})')} as {s}" for s in KEY_STATS)},
  {', '.join(f"{R4(f'avg({e})')} as {n}" for n, e in _RATIO_SQL.items())}
from c where SEASON_YEAR is not null group by l_suppkey, SEASON_YEAR
""")
def season_means_q(spark, sf_dir):
    sm = season_means(_boxed_seasons(spark, sf_dir), ["l_suppkey"], "SEASON_YEAR")
    return sm.select("l_suppkey", "SEASON_YEAR", "GAMES_PLAYED",
                     *[F.round(F.col(c).cast("decimal(38,8)"), 4).cast("double").alias(c)
                       for c in KEY_STATS + [n for n, _, _ in SHOOTING]])


# ----------------------------------------------------------------- ratio_of_sums
@register("ratio_of_sums", "E3 E4", f"""
with b as ({BOX_SQL}), c as (select *, {_LABEL_SQL} as SEASON_YEAR from b)
select l_suppkey, SEASON_YEAR, count(*) as GAMES,
  {', '.join(f"{R4(f'case when sum({a}) > 0 then sum({m}) / sum({a}) end')} as {n}" for n, m, a in SHOOTING)},
  {R4('avg(case when FGA + 0.44 * FTA > 0 then PTS / (2 * (FGA + 0.44 * FTA)) end)')} as TS_PCT_AVG,
  {R4('avg(case when TOV > 0 then AST / TOV when AST > 0 then AST end)')} as AST_TOV_AVG
from c group by l_suppkey, SEASON_YEAR
""")
def ratio_of_sums(spark, sf_dir):
    b = _boxed_seasons(spark, sf_dir).withColumns({
        "TS_PCT": R.true_shooting("PTS", "FGA", "FTA", "null"), "AST_TOV": R.ast_to_tov("AST", "TOV")})
    out = season_shooting(b, ["l_suppkey"], "SEASON_YEAR", ["TS_PCT", "AST_TOV"])
    dbl = [n for n, _, _ in SHOOTING] + ["TS_PCT_AVG", "AST_TOV_AVG"]
    return out.select("l_suppkey", "SEASON_YEAR", "GAMES",
                      *[F.round(F.col(c).cast("decimal(38,8)"), 4).cast("double").alias(c) for c in dbl])


# ----------------------------------------------------------------- distinct_opponents (E5)
@register("distinct_opponents", "E5", f"""
with b as ({BOX_SQL})
select distinct string_split(MATCHUP, ' ')[-1] as opponent from b where MATCHUP is not null
""")
def distinct_opponents(spark, sf_dir):
    b = box_scores(spark, sf_dir).withColumn(
        "opponent", F.when(F.col("MATCHUP").isNotNull(), F.element_at(F.split("MATCHUP", " "), -1)))
    return distinct_values(b, "opponent")


# ----------------------------------------------------------------- season_lag_features
_SEASON_STATS = KEY_STATS + [n for n, _, _ in SHOOTING]


def _season_set_sql(target="PTS") -> str:
    W = "partition by l_suppkey order by SEASON_YEAR"
    prev = ", ".join(f"{R4(f'lag({s}) over ({W})')} as PREV_SEASON_{s}" for s in _SEASON_STATS)
    a, b = f"lag({target}, 1) over ({W})", f"lag({target}, 2) over ({W})"
    return f"""
with b as ({BOX_SQL}), c as (select *, {_LABEL_SQL} as SEASON_YEAR from b),
s as (select l_suppkey, SEASON_YEAR, count(*) as GAMES_PLAYED,
        {', '.join(f"avg({x}) as {x}" for x in KEY_STATS)},
        {', '.join(f"avg({e}) as {n}" for n, e in _RATIO_SQL.items())}
      from c group by l_suppkey, SEASON_YEAR),
f as (select l_suppkey, SEASON_YEAR, {prev},
        lag(GAMES_PLAYED) over ({W}) as PREV_SEASON_GAMES,
        lag(SEASON_YEAR) over ({W}) as PREV_SEASON,
        cast(row_number() over ({W}) - 1 + 20 as int) as AGE,
        cast(row_number() over ({W}) - 1 as int) as EXPERIENCE,
        {R4(f'case when row_number() over ({W}) - 1 >= 2 then {a} - {b} else 0.0 end')} as SEASON_TREND,
        {R4(f'case when row_number() over ({W}) - 1 = 1 then {a} else ({a} + {b}) / 2 end')} as PREV_{target}_2YR_AVG,
        {R4(target)} as TARGET
      from s)
select * from f where EXPERIENCE >= 1
"""


@register("season_lag_features", "D20 D21 F5 E1 E2", _season_set_sql())
def season_lag_features_q(spark, sf_dir):
    df = TR.season_set(box_scores(spark, sf_dir), BOX, "PTS")
    dbl = [f"PREV_SEASON_{s}" for s in _SEASON_STATS] + ["SEASON_TREND", "PREV_PTS_2YR_AVG", "TARGET"]
    return df.select("l_suppkey", "SEASON_YEAR",
                     *[F.round(F.col(c).cast("decimal(38,8)"), 4).cast("double").alias(c) for c in dbl],
                     "PREV_SEASON_GAMES", "PREV_SEASON", "AGE", "EXPERIENCE")


# ----------------------------------------------------------------- season_trend (D21 on orders)
@register("season_trend", "D21 E1", """
with s as (select o_custkey, year(o_orderdate) as yr, avg(o_totalprice) as price from orders group by all),
f as (select o_custkey, yr, row_number() over (partition by o_custkey order by yr) - 1 as i,
        lag(price, 1) over (partition by o_custkey order by yr) as a,
        lag(price, 2) over (partition by o_custkey order by yr) as b from s)
select o_custkey, cast(yr as int) as season,
  cast(round(cast(case when i >= 2 then a - b else 0.0 end as decimal(38,8)), 4) as double) as trend,
  cast(round(cast(case when i = 1 then a else (a + b) / 2 end as decimal(38,8)), 4) as double) as two_season_avg
from f where i >= 1
""")
def season_trend(spark, sf_dir):
    o = orders_log(spark, sf_dir)
    s = o.groupBy("o_custkey", "season").agg(F.avg("o_totalprice").alias("price"),
                                             F.count(F.lit(1)).alias("GAMES_PLAYED"))
    f = season_lag_features(s, "o_custkey", "season", [], "price")
    return f.select("o_custkey", F.col("season").cast("int").alias("season"),
                    F.round(F.col("SEASON_TREND").cast("decimal(38,8)"), 4).cast("double").alias("trend"),
                    F.round(F.col("PREV_price_2YR_AVG").cast("decimal(38,8)"), 4).cast("double")
                    .alias("two_season_avg"))


# ----------------------------------------------------------------- team_win_set (App. A)
_INT_FEATS = {"PREV_GAME_WIN", "WON_1_AGO", "WON_2_AGO", "WON_3_AGO", "HOME", "DAYS_REST", "BACK_TO_BACK",
              "GAME_NUMBER", "BLOWOUT_WIN", "CLOSE_GAME"}


def _team_win_sql() -> str:
    feats = TR.team_win_features()
    roll = []
    for n in TR.WINDOWS:
        roll.append(f"cast({roll_sum('WIN', n, W_LI)} as double) as WIN_STREAK_{n}")
        roll.append(f"{roll_avg('WIN', n, W_LI)} as WIN_PCT_{n}")
        for st in ("PTS", "FGM", "FG3M", "AST", "REB", "STL", "BLK", "TOV", "PLUS_MINUS"):
            roll.append(f"{roll_avg(st, n, W_LI)} as {st}_AVG_{n}")
    notnull = " and ".join(f"{f} is not null" for f in feats)
    out = ", ".join(f if f in _INT_FEATS else f"{R4(f)} as {f}" for f in feats)
    return f"""
with b as ({BOX_SQL}), c as (select *, cast(WL = 'W' as int) as WIN from b),
d as (select l_suppkey, l_orderkey, l_linenumber, l_partkey, WIN,
        cast(row_number() over ({W_LI}) as int) as GAME_NUMBER,
        count(*) over (partition by l_suppkey) as N,
        {', '.join(roll)},
        cast(coalesce(lag(WIN, 1) over ({W_LI}), 0) as int) as PREV_GAME_WIN,
        cast(coalesce(lag(WIN, 1) over ({W_LI}), 0) as int) as WON_1_AGO,
        cast(coalesce(lag(WIN, 2) over ({W_LI}), 0) as int) as WON_2_AGO,
        cast(coalesce(lag(WIN, 3) over ({W_LI}), 0) as int) as WON_3_AGO,
        coalesce(cast(contains(MATCHUP, 'vs.') as int), 0) as HOME,
        cast(coalesce(date_sub('day', lag(l_shipdate) over ({W_LI}), l_shipdate), 3) as int) as DAYS_REST,
        cast(PLUS_MINUS > 15 and WIN = 1 as int) as BLOWOUT_WIN,
        cast(abs(PLUS_MINUS) < 5 as int) as CLOSE_GAME,
        case when 2 * (FGA + 0.44 * FTA) > 0 then PTS / (2 * (FGA + 0.44 * FTA)) else 0.0 end as TS_PCT
      from c),
e as (select *, cast(DAYS_REST < 2 as int) as BACK_TO_BACK from d
      where GAME_NUMBER > greatest(10, floor(N * 0.1))),
f as (select *, count(*) over (partition by l_suppkey) as N2 from e where {notnull} and WIN is not null)
select l_suppkey, l_orderkey, l_linenumber, l_partkey, {out}, WIN from f where N2 >= 10
"""


@register("team_win_set", "App.A D10 D14 D15 C16 C21 B11-B14", _team_win_sql())
def team_win_set(spark, sf_dir):
    df = TR.team_win_set(box_scores(for_wide_rows(spark), sf_dir), BOX)
    feats = TR.team_win_features()
    return df.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey",
                     *[F.col(f) if f in _INT_FEATS else
                       F.round(F.col(f).cast("decimal(38,8)"), 4).cast("double").alias(f) for f in feats],
                     "WIN")


# ----------------------------------------------------------------- career_set (App. A)
def _career_sql(target="PTS") -> str:
    stats = [s for s in KEY_STATS if s != target]
    run = f"({W_LI} rows between unbounded preceding and current row)"
    return f"""
with b as ({BOX_SQL}),
c as (select l_suppkey, l_orderkey, l_linenumber, l_partkey, {target},
        cast(row_number() over ({W_LI}) as int) as GAME_NUMBER,
        {', '.join(f"{R4(f'avg({s}) over {run}')} as CAREER_{s}_AVG" for s in stats)},
        count(*) over (partition by l_suppkey) as N from b)
select l_suppkey, l_orderkey, l_linenumber, l_partkey, GAME_NUMBER as CAREER_GAMES,
  {', '.join(f"CAREER_{s}_AVG" for s in stats)}, GAME_NUMBER, {R4(target)} as TARGET
from c where N >= 10
"""


@register("career_set", "App.A D5 D17 B12", _career_sql())
def career_set(spark, sf_dir):
    df = TR.career_set(box_scores(spark, sf_dir), BOX, "PTS")
    feats = [c for c in df.columns if c.startswith("CAREER_") and c.endswith("_AVG")]
    return df.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "CAREER_GAMES",
                     *[F.round(F.col(c).cast("decimal(38,8)"), 4).cast("double").alias(c) for c in feats],
                     "GAME_NUMBER", F.round(F.col("TARGET").cast("decimal(38,8)"), 4).cast("double")
                     .alias("TARGET"))


