"""Clean pipelines, scoring rows and source reads over the driver tables
(SURVEY A2-A7, A10, A11, B14, B15, C19, C27, G3, H1), each with its oracle."""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import functions as F

from perflog.functions import calendar as cal
from perflog.functions import parsing as P
from perflog.operators import clean as C
from perflog.operators.ranking import latest_per_entity, union_seasons
from perflog.operators.seasons import next_season_row
from perflog.operators.windows import zscore
from perflog.plans import training as TR
from perflog.plans.bindings import BOX, BOX_SQL, box_scores
from perflog.plans.cleaning import player_log_clean, team_log_clean
from perflog.plans.registry import register
from perflog.plans.sqlbits import R4, prior_avg, r4, roll_avg, rows
from perflog.session import checkpoint_dir
from perflog.sources.store import read_through
from perflog.sources.tables import DRIVER_SCHEMAS, exists, read_table, read_where
from perflog.spec import LogSpec

RAW = LogSpec(entity="l_suppkey", time="GAME_DATE", tie=("l_orderkey", "l_linenumber", "l_partkey"), outcome="WL")
KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]
W_RAW = "partition by l_suppkey order by GAME_DATE, l_orderkey, l_linenumber, l_partkey"


def raw_log(spark, sf_dir):
    """Lineitem as a raw log with what raw logs bring: text dates and minutes, NaN, unknown results."""
    li = read_table(spark, sf_dir, "lineitem")
    q, ln = F.col("l_quantity"), F.col("l_linenumber")
    nan = F.lit(float("nan"))
    return li.select(
        "l_suppkey", *KEYS, F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("GAME_DATE"),
        F.when(ln == 7, nan).otherwise(q).alias("PTS"), F.floor(q / 10).cast("double").alias("FGM"), (ln - 1).cast("double").alias("FGA"),
        F.when(F.col("l_tax") > 0, F.round(F.col("l_tax") * 100)).cast("string").alias("FTA"), (ln % 3).cast("string").alias("TOV"), (q - 25.5).alias("PLUS_MINUS"),
        F.when(ln == 5, "").when(ln == 6, "20m").otherwise(F.concat((20 + q.cast("int") % 20).cast("string"), F.lit(":30"))).alias("MIN"),
        F.when(F.col("l_returnflag") == "A", None).when(F.col("l_linestatus") == "F", "W").otherwise("L").alias("WL"),
        F.when(ln == 2, None).otherwise(F.concat(F.lit("S"), F.when(ln % 2 == 0, " @ ").otherwise(" vs. "), F.lit("N"),
                                                 (F.col("l_partkey") % 30).cast("string"))).alias("MATCHUP"))


_FILL = "coalesce({0}, avg({0}) over (partition by l_suppkey))"
_RAW_SQL = f"""r as (
  select l_suppkey, l_orderkey, l_linenumber, l_partkey, l_shipdate as GAME_DATE,
    case when l_linenumber <> 7 then l_quantity end as PTS, cast(floor(l_quantity / 10) as double) as FGM, cast(l_linenumber - 1 as double) as FGA,
    case when l_tax > 0 then round(l_tax * 100) end as FTA, cast(l_linenumber % 3 as double) as TOV, l_quantity - 25.5 as PLUS_MINUS,
    case when l_linenumber = 5 then null when l_linenumber = 6 then 20.0 else 20 + cast(l_quantity as int) % 20 + 0.5 end as MIN,
    case when l_returnflag = 'A' then 'UNK' when l_linestatus = 'F' then 'W' else 'L' end as WL,
    case when l_linenumber = 2 then 'UNK' else 'S' || case when l_linenumber % 2 = 0 then ' @ ' else ' vs. ' end || 'N' || cast(l_partkey % 30 as varchar) end as MATCHUP,
    case when l_linenumber = 2 then 'UNK' else 'N' || cast(l_partkey % 30 as varchar) end as OPPONENT
  from lineitem),
b as (select * replace ({', '.join(f"{_FILL.format(c)} as {c}" for c in ('PTS', 'FTA', 'MIN'))}) from r)"""
_Z = "case when stddev_samp(PTS) over (partition by l_suppkey) > 0 then (PTS - avg(PTS) over (partition by l_suppkey)) / stddev_samp(PTS) over (partition by l_suppkey) end"
_REST = f"cast(coalesce(date_sub('day', lag(GAME_DATE) over ({W_RAW}), GAME_DATE), 3) as int)"


@register("player_log_clean", "A4 B2 B4 B7 B8 C1 C3 C4 C6 C8 C15 C16 C17 D1 D6 D16 D17 D19", f"""
with {_RAW_SQL}
select l_orderkey, l_linenumber, l_partkey, {R4('PTS')} as pts, {R4('MIN')} as min, WL as wl, OPPONENT as opponent,
  cast(contains(MATCHUP, 'vs.') as int) as home, {R4('case when FGA + 0.44 * FTA > 0 then PTS / (2 * (FGA + 0.44 * FTA)) end')} as ts_pct,
  {R4('FGA + 0.44 * FTA + TOV')} as usage_rate, {_REST} as days_rest, cast({_REST} <= 1 as int) as back_to_back,
  cast(row_number() over ({W_RAW}) as int) as game_number, {R4(roll_avg('PTS', 3, W_RAW))} as pts_avg_3,
  {R4(f'PTS - lag(PTS) over ({W_RAW})')} as pts_diff, cast(month(GAME_DATE) in (10, 11, 12) as int) as early_season,
  cast(WL = 'W' as int) as win, {R4(_Z)} as pts_zscore
from b
""")
def player_log_clean_q(spark, sf_dir):
    df = player_log_clean(raw_log(spark, sf_dir), RAW)
    return df.select(*KEYS, *[r4(c).alias(c.lower()) for c in ("PTS", "MIN", "TS_PCT", "USAGE_RATE", "PTS_AVG_3", "PTS_DIFF", "PTS_ZSCORE")],
                     *[F.col(c).alias(c.lower()) for c in ("WL", "OPPONENT", "HOME", "DAYS_REST", "BACK_TO_BACK", "GAME_NUMBER", "EARLY_SEASON", "WIN")])


@register("team_log_clean", "A5 B2 B4 B7 B8 C1 C3 C12 C21 D8 D10 D13 D16 D18 D19", f"""
with {_RAW_SQL},
s as (select *, {prior_avg('PLUS_MINUS', 3, W_RAW)} as p3, {_REST} as rest, {_Z} as z, row_number() over ({W_RAW}) as rn,
        case when lag(WL) over ({W_RAW}) is distinct from WL then row_number() over ({W_RAW}) end as st from b),
t as (select *, coalesce(p3 - lag(p3) over ({W_RAW}), 0) as trend, rn - max(st) over {rows(W_RAW, None, 0)} + 1 as run from s)
select l_orderkey, l_linenumber, l_partkey, {R4('PTS')} as pts, WL as wl, OPPONENT as opponent, cast(contains(MATCHUP, 'vs.') as int) as home,
  cast(case when WL = 'W' then run else 0 end as int) as win_streak, cast(case when WL = 'L' then run else 0 end as int) as loss_streak,
  {R4('trend')} as pm_trend, cast(trend > 5 as int) as positive_momentum, cast(trend < -5 as int) as negative_momentum,
  {R4('TOV / case when FGA + 0.44 * FTA + TOV > 0 then FGA + 0.44 * FTA + TOV else 1 end')} as tov_pct,
  cast(abs(PLUS_MINUS) < 5 as int) as close_game, cast(rest >= 3 as int) as extra_rest, {R4('z')} as pts_zscore
from t
""")
def team_log_clean_q(spark, sf_dir):
    df = team_log_clean(raw_log(spark, sf_dir).drop("MIN"), RAW)
    return df.select(*KEYS, *[r4(c).alias(c.lower()) for c in ("PTS", "PM_TREND", "TOV_PCT", "PTS_ZSCORE")],
                     *[F.col(c).alias(c.lower()) for c in ("WL", "OPPONENT", "HOME", "WIN_STREAK", "LOSS_STREAK", "POSITIVE_MOMENTUM",
                                                           "NEGATIVE_MOMENTUM", "CLOSE_GAME", "EXTRA_REST")])


# ----------------------------------------------------------------- next_game_row
OPPONENTS = [f"N{i}" for i in range(5)]
_NEXT = [f"PTS_{k}_{n}" for n in (3, 5, 10) for k in ("AVG", "STD", "EMA")]


@register("next_game_row", "C27 I1 F4", f"""
with b as ({BOX_SQL}), a as (select l_suppkey, avg(PTS) as p, avg(MIN) as m, avg(FGA) as fga, avg(FTA) as fta, avg(TOV) as tov, avg(AST) as ast,
  max(l_shipdate) as last from b group by l_suppkey),
q as (select s_suppkey, timestamp '2030-01-01 00:00:00' as d, 'N' || cast(s_suppkey % 30 as varchar) as opp, s_suppkey % 2 as home from supplier),
j as (select *, cast(date_sub('day', last, d) as int) as rest from q join a on q.s_suppkey = a.l_suppkey)
select l_suppkey, opp as opponent, {', '.join(f"{R4('p * 0.1' if '_STD_' in c else 'p')} as {c.lower()}" for c in _NEXT)},
  {R4('m')} as min, {R4('ast')} as ast_avg_5, {R4('case when fga + 0.44 * fta > 0 then p / (2 * (fga + 0.44 * fta)) else 0 end')} as ts_pct_avg_5,
  {R4('fga + 0.44 * fta + tov')} as usage_rate_avg_10, cast(home as int) as home, rest as days_rest, cast(rest > 3 as int) as extended_rest,
  1 as mid_season, cast(coalesce(n.n_regionkey + 1, 3) as int) as opp_strength, {', '.join(f"cast(opp = '{o}' as int) as opp_{o.lower()}" for o in OPPONENTS)}
from j left join nation n on opp = 'N' || cast(n.n_nationkey as varchar)
""")
def next_game_row(spark, sf_dir):
    """Every supplier's row for a game at a fixed date."""
    from perflog.plans.q_lookups import team_dimension
    s = read_table(spark, sf_dir, "supplier")
    requests = s.select(F.col("s_suppkey").alias("l_suppkey"), F.lit("2030-01-01 00:00:00").cast("timestamp_ntz").alias("GAME_DATE"),
                        F.concat(F.lit("N"), (F.col("s_suppkey") % 30).cast("string")).alias("OPPONENT"), (F.col("s_suppkey") % 2).alias("IS_HOME"))
    rows_ = TR.next_game_row(box_scores(spark, sf_dir), BOX, requests, OPPONENTS, team_dimension(spark, sf_dir))
    return rows_.select("l_suppkey", F.col("OPPONENT").alias("opponent"), *[r4(c).alias(c.lower()) for c in [*_NEXT, "MIN", "AST_AVG_5", "TS_PCT_AVG_5", "USAGE_RATE_AVG_10"]],
                        *[F.col(c).cast("int").alias(c.lower()) for c in ["HOME", "DAYS_REST", "EXTENDED_REST", "MID_SEASON", "OPP_STRENGTH", *[f"OPP_{o}" for o in OPPONENTS]]])


# ----------------------------------------------------------------- sources
@register("roster", "A2 A3 H1", """
with t as (select n_nationkey from nation join region on n_regionkey = r_regionkey where r_name in ('AFRICA', 'ASIA'))
select c_custkey as id, c_name as name, c_nationkey as team from customer where c_nationkey in (select n_nationkey from t)
union all select s_suppkey as id, s_name as name, s_nationkey as team from supplier where s_nationkey in (select n_nationkey from t)
""")
def roster(spark, sf_dir):
    """Two roster shapes made one: (PLAYER, PLAYER_ID) and (full_name, id), of the teams of a league: a semi-join with the table of teams."""
    a = read_table(spark, sf_dir, "customer").select(F.col("c_name").alias("PLAYER"), F.col("c_custkey").alias("PLAYER_ID"), F.col("c_nationkey").alias("team"))
    b = read_table(spark, sf_dir, "supplier").select(F.col("s_name").alias("full_name"), F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("team"))
    league = read_table(spark, sf_dir, "region").where(F.col("r_name").isin("AFRICA", "ASIA"))
    teams = read_table(spark, sf_dir, "nation").join(league, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    both = union_seasons([a, b]).join(teams, F.col("team") == F.col("n_nationkey"), "left_semi")
    return both.select(F.coalesce("id", "PLAYER_ID").alias("id"), F.coalesce("full_name", "PLAYER").alias("name"), "team")


@register("boxscore_by_game", "A7 A10 B15", """
select l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'P')
""")
def boxscore_by_game(spark, sf_dir):
    """Box scores of the games of a key table (those still pending); columns that don't exist are left out."""
    games = read_where(spark, f"{sf_dir}/orders.parquet", F.col("o_orderstatus") == "P", ["o_orderkey"], DRIVER_SCHEMAS["orders"])
    df = read_table(spark, sf_dir, "lineitem").join(games, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return C.select_present(df, ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "NO_SUCH_COLUMN"])


@register("player_log_recent", "A4 G2", f"""
with {_RAW_SQL.replace('from lineitem)', 'from lineitem where year(l_shipdate) = 1997)')},
w as (select *, row_number() over ({W_RAW}) as k, count(*) over (partition by l_suppkey) as n, {roll_avg('PTS', 3, W_RAW)} as a3, {_REST} as rest from b)
select l_orderkey, l_linenumber, l_partkey, {R4('PTS')} as pts, {R4('a3')} as pts_avg_3, rest as days_rest, cast(k as int) as game_number from w where k > n - 5
""")
def player_log_recent(spark, sf_dir):
    """Every player's last five games of a season, cleaned over the whole season."""
    df = player_log_clean(raw_log(spark, sf_dir), RAW, season=F.year("GAME_DATE") == 1997, last_n=5)
    return df.select(*KEYS, r4("PTS").alias("pts"), r4("PTS_AVG_3").alias("pts_avg_3"), F.col("DAYS_REST").alias("days_rest"), F.col("GAME_NUMBER").alias("game_number"))


@register("latest_season", "G3 C18 C19", """
with y as (select o_custkey, year(o_orderdate) as season, count(*) as games from orders group by all),
r as (select *, row_number() over (partition by o_custkey order by season desc) as k from y)
select a.o_custkey, cast(a.season as int) as season, a.games, cast(b.season as double) as second_season,
  cast(a.season >= year(date '1998-08-02') as boolean) as is_current
from r a left join r b on a.o_custkey = b.o_custkey and b.k = 2 where a.k = 1
""")
def latest_season(spark, sf_dir):
    """Every customer's latest season, and the one before it."""
    y = read_table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("season")).agg(F.count(F.lit(1)).alias("games"))
    second = latest_per_entity(y, ["o_custkey"], "season", 1).select("o_custkey", F.col("season").cast("double").alias("second_season"))
    now = cal.current_season(_dt.date(1998, 8, 2), "year")
    return latest_per_entity(y, ["o_custkey"], "season").join(second, "o_custkey", "left").select(
        "o_custkey", "season", "games", "second_season", (F.col("season") >= now).alias("is_current"))


# ----------------------------------------------------------------- next_season_row
_SEASONS = ["PTS", "MIN", "AST"]


@register("next_season_row", "I14 G3 E1", f"""
with b as ({BOX_SQL}), s as (select l_suppkey, year(l_shipdate) as season, count(*) as games, {', '.join(f"avg({c}) as {c}" for c in _SEASONS)} from b group by all),
r as (select *, row_number() over w as i, count(*) over (partition by l_suppkey) as n, lag(PTS, 1) over w as before from s
      window w as (partition by l_suppkey order by season))
select l_suppkey, cast(season as int) as latest_season, games, cast(i + 20 as int) as age, cast(i as int) as experience, {', '.join(f"{R4(c)} as prev_{c.lower()}" for c in _SEASONS)},
  {R4('case when i >= 2 then PTS - before else 0.0 end')} as trend, {R4('case when i = 1 then PTS else (PTS + before) / 2 end')} as two_season_avg
from r where i = n
""")
def next_season_row_q(spark, sf_dir):
    """Every supplier's row for the season after its latest one."""
    b = box_scores(spark, sf_dir).withColumn("year", F.year("l_shipdate"))
    seasons = b.groupBy("l_suppkey", "year").agg(F.count(F.lit(1)).alias("GAMES_PLAYED"), *[F.avg(c).alias(c) for c in _SEASONS])
    out = next_season_row(seasons, "l_suppkey", "year", _SEASONS, "PTS")
    return out.select("l_suppkey", F.col("year").cast("int").alias("latest_season"), F.col("GAMES_PLAYED").alias("games"), F.col("AGE").alias("age"),
                      F.col("EXPERIENCE").alias("experience"), *[r4(f"PREV_SEASON_{c}").alias(f"prev_{c.lower()}") for c in _SEASONS],
                      r4("SEASON_TREND").alias("trend"), r4("PREV_PTS_2YR_AVG").alias("two_season_avg"))


# ----------------------------------------------------------------- numeric_zscores
_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("numeric_zscores", "B14 D19", "select l_orderkey, l_linenumber, l_partkey, " + ", ".join(
    R4(f"case when stddev_samp({c}) over (partition by l_suppkey) > 0 then ({c} - avg({c}) over (partition by l_suppkey)) / stddev_samp({c}) over (partition by l_suppkey) end")
    + f" as {c}_z" for c in _NUMERIC) + " from lineitem")
def numeric_zscores(spark, sf_dir):
    """All numeric columns of a log, found by its schema without keys, dates and numbers of lines, scaled by entity."""
    li = read_table(spark, sf_dir, "lineitem")
    cols = C.zscore_columns(li, ("key", "date", "linenumber"))
    out = zscore(li.select("l_suppkey", *KEYS, *cols), cols, BOX)
    return out.select(*KEYS, *[r4(f"{c}_ZSCORE").alias(f"{c}_z") for c in cols])


# ----------------------------------------------------------------- null_profile_change (B1 before and after)
@register("null_profile_change", "B1 B2 B4", f"""
with {_RAW_SQL.replace("case when l_returnflag = 'A' then 'UNK' when", "case when l_returnflag = 'A' then null when").replace("case when l_linenumber = 2 then 'UNK' else 'S'", "case when l_linenumber = 2 then null else 'S'")}
select 'PTS' as column_name, count(*) filter (where r.PTS is null) as nulls_before, (select count(*) from b where PTS is null) as nulls_after from r
union all select 'FTA', count(*) filter (where r.FTA is null), (select count(*) from b where FTA is null) from r
union all select 'MATCHUP', count(*) filter (where r.MATCHUP is null), 0 from r
""")
def null_profile_change(spark, sf_dir):
    """Nulls by column before and after cleaning a raw log."""
    raw = raw_log(spark, sf_dir)
    before = raw.withColumns({c: P.nan_to_null(P.to_double(c)) for c in ("PTS", "FTA")})
    after = player_log_clean(raw, RAW)
    return C.null_profile_change(before, after, ["PTS", "FTA", "MATCHUP"]).withColumnRenamed("column", "column_name")


# ----------------------------------------------------------------- stored_seasons
@register("stored_seasons", "A11 A13 E8", """
with s as (select year(o_orderdate) as season, count(*) as games, max(o_orderdate) as last from orders group by 1)
select cast(season as int) as season, games, epoch_us(last) as last_us, cast(games > 0 as boolean) as present from s
union all select 1900, 0, 0, false
""")
def stored_seasons(spark, sf_dir):
    """A table of seasons built once and read back on the next call, with an existence test of each season and of one that isn't there."""
    path = f"{checkpoint_dir(spark)}/seasons-{uuid.uuid4().hex}"
    calls = []

    def build():
        calls.append(1)
        o = read_table(spark, sf_dir, "orders")
        return o.groupBy(F.year("o_orderdate").alias("season")).agg(F.count(F.lit(1)).alias("games"), F.max("o_orderdate").alias("last")).coalesce(1)

    read_through(spark, path, build)
    stored = read_through(spark, path, build)  # not built again
    if len(calls) != 1:
        raise RuntimeError("the stored table was built twice")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    rows = stored.select("season", "games", F.timestamp_diff("MICROSECOND", epoch, "last").alias("last_us"), F.lit(True).alias("present"))
    missing = exists(stored, F.col("season") == 1900)
    gone = stored.limit(1).select(F.lit(1900).alias("season"), F.lit(0).cast("long").alias("games"), F.lit(0).cast("long").alias("last_us"), F.lit(missing).alias("present"))
    return rows.unionByName(gone)
