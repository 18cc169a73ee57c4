"""Scalar-function and cleaning queries with DuckDB oracles."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from perflog.functions import calendar as cal
from perflog.functions import parsing as P
from perflog.functions import predict as PR
from perflog.functions import ratios as R
from perflog.operators import clean as C
from perflog.operators import windows as Wn
from perflog.plans.bindings import BOX, BOX_SQL, EVENTS, ORDERS, box_scores, events_log, orders_log
from perflog.operators.lookups import with_role_context
from perflog.operators.stats import with_entity_stats
from perflog.operators.split import in_pieces
from perflog.plans.registry import register
from perflog.plans.sqlbits import R4, W_EV, W_LI, r4, roll_avg

KEYS = ("l_orderkey", "l_linenumber", "l_partkey")


# ----------------------------------------------------------------- matchup_parse
@register("matchup_parse", "C1 C2 C3", f"""
with b as ({BOX_SQL})
select l_orderkey, l_linenumber, l_partkey,
  coalesce(cast(contains(MATCHUP, 'vs.') as int), 0) as home,
  coalesce(cast(contains(MATCHUP, '@') as int), 0) as away,
  case when MATCHUP is null then null
       when contains(MATCHUP, 'vs.') then string_split(MATCHUP, 'vs. ')[-1]
       when contains(MATCHUP, '@') then string_split(MATCHUP, '@ ')[-1]
       else string_split(MATCHUP, ' ')[-1] end as opponent,
  case when contains(coalesce(MATCHUP, 'None'), '@')
       then replace(string_split_regex(trim(coalesce(MATCHUP, 'None')), '\\s+')[-1], '@', '')
       else string_split_regex(trim(coalesce(MATCHUP, 'None')), '\\s+')[-1] end as opponent_token
from b
""")
def matchup_parse(spark, sf_dir):
    b = box_scores(spark, sf_dir)
    return b.select(*KEYS, P.is_home("MATCHUP").alias("home"), P.is_away("MATCHUP").alias("away"),
                    P.opponent("MATCHUP").alias("opponent"),
                    P.opponent_last_token("MATCHUP").alias("opponent_token"))


# ----------------------------------------------------------------- minutes_parse
_RAW_MIN_SQL = """
case l_returnflag
  when 'A' then concat(cast(cast(l_quantity as int) as varchar), ':',
                       lpad(cast((l_linenumber * 7) % 60 as varchar), 2, '0'))
  when 'N' then case when l_linenumber = 7 then ' ' else cast(cast(l_quantity as int) as varchar) end
  else case when l_linestatus = 'F' then concat(cast(cast(l_quantity as int) as varchar), 'm')
            when l_linenumber = 1 then null
            else concat(cast(l_linenumber as varchar), ':xx') end end"""


def _raw_minutes():
    q = F.col("l_quantity").cast("int").cast("string")
    ln = F.col("l_linenumber")
    return (F.when(F.col("l_returnflag") == "A",
                   F.concat(q, F.lit(":"), F.lpad(((ln * 7) % 60).cast("string"), 2, "0")))
             .when(F.col("l_returnflag") == "N", F.when(ln == 7, F.lit(" ")).otherwise(q))
             .otherwise(F.when(F.col("l_linestatus") == "F", F.concat(q, F.lit("m")))
                        .when(ln == 1, F.lit(None).cast("string"))
                        .otherwise(F.concat(ln.cast("string"), F.lit(":xx")))))


_T = "trim(raw)"
_COLON_OK = (f"contains({_T}, ':') and len(string_split({_T}, ':')) = 2 "
             f"and try_cast(split_part({_T}, ':', 1) as double) is not null "
             f"and try_cast(split_part({_T}, ':', 2) as double) is not null")
_COLON_VAL = (f"try_cast(split_part({_T}, ':', 1) as double) + "
              f"try_cast(split_part({_T}, ':', 2) as double) / 60")
_DIGITS = f"try_cast(nullif(regexp_extract({_T}, '(\\d+)', 1), '') as double)"


@register("minutes_parse", "C4 C5", f"""
with b as (select l_orderkey, l_linenumber, l_partkey, {_RAW_MIN_SQL} as raw from lineitem)
select l_orderkey, l_linenumber, l_partkey, raw,
  {R4(f'''case when raw is null or {_T} = '' then null
       when {_COLON_OK} then {_COLON_VAL}
       when try_cast({_T} as double) is not null then try_cast({_T} as double)
       else {_DIGITS} end''')} as minutes,
  {R4(f'''case when raw is null or {_T} = '' then 0.0
       when contains({_T}, ':') then coalesce(case when {_COLON_OK} then {_COLON_VAL} end, {_DIGITS}, 0.0)
       else coalesce(try_cast({_T} as double), 0.0) end''')} as minutes_or_zero
from b
""")
def minutes_parse(spark, sf_dir):
    li = box_scores(spark, sf_dir).withColumn("raw", _raw_minutes())
    return li.select(*KEYS, "raw", r4(P.minutes("raw")).alias("minutes"),
                     r4(P.minutes_or_zero("raw")).alias("minutes_or_zero"))


# ----------------------------------------------------------------- efficiency_ratios
@register("efficiency_ratios", "C6-C11", f"""
with b as ({BOX_SQL}),
c as (select *, case when FTA > 0 then FTM / FTA else 0.0 end as FT_PCT from b)
select l_orderkey, l_linenumber, l_partkey,
  {R4('case when FGA + 0.44 * FTA > 0 then PTS / (2 * (FGA + 0.44 * FTA)) end')} as ts_pct,
  {R4('case when 2 * (FGA + 0.44 * FTA) > 0 then PTS / (2 * (FGA + 0.44 * FTA)) else 0.0 end')} as ts_pct_or_zero,
  {R4('case when FGA > 0 then (FGM + 0.5 * FG3M) / FGA end')} as efg_pct,
  {R4('FGA + 0.44 * FTA + TOV')} as usage,
  {R4('case when FGA >= 0 and FTA >= 0 and TOV >= 0 then FGA + 0.44 * FTA + TOV else 0.0 end')} as usage_nonneg,
  {R4('case when TOV > 0 then AST / TOV when AST > 0 then AST end')} as ast_tov,
  {R4('case when FGA + 0.44 * FTA + TOV - OREB > 0 then 100 * (FGM + (1 - pow(1 - FT_PCT, 2)) * FTA * 0.5) / (FGA + 0.44 * FTA + TOV - OREB) end')} as off_rating,
  {R4('case when FGA > 0 then FGM / FGA else 0.0 end')} as fg_pct,
  {R4('case when FG3A > 0 then FG3M / FG3A else 0.0 end')} as fg3_pct,
  {R4('FT_PCT')} as ft_pct,
  cast(coalesce(cast(WL = 'W' as int), 0) as int) as win
from c
""")
def efficiency_ratios(spark, sf_dir):
    b = box_scores(spark, sf_dir).withColumn("FT_PCT", R.shooting_pct("FTM", "FTA"))
    return b.select(
        *KEYS,
        r4(R.true_shooting("PTS", "FGA", "FTA", "null")).alias("ts_pct"),
        r4(R.true_shooting("PTS", "FGA", "FTA", "zero")).alias("ts_pct_or_zero"),
        r4(R.effective_fg("FGM", "FG3M", "FGA", "null")).alias("efg_pct"),
        r4(R.usage("FGA", "FTA", "TOV")).alias("usage"),
        r4(R.usage("FGA", "FTA", "TOV", negative_to_zero=True)).alias("usage_nonneg"),
        r4(R.ast_to_tov("AST", "TOV")).alias("ast_tov"),
        r4(R.offensive_rating("FGM", "FT_PCT", "FTA", "FGA", "TOV", "OREB")).alias("off_rating"),
        r4(R.shooting_pct("FGM", "FGA")).alias("fg_pct"),
        r4(R.shooting_pct("FG3M", "FG3A")).alias("fg3_pct"),
        r4("FT_PCT").alias("ft_pct"),
        R.win_flag("WL").cast("int").alias("win"))


# ----------------------------------------------------------------- team_ratings
@register("team_ratings", "C12 C13 C14 C21", f"""
with b as ({BOX_SQL}),
c as (select *, FGA + 0.44 * FTA - OREB + TOV as POSS, max(MIN) over (partition by l_suppkey) as mx from b)
select l_orderkey, l_linenumber, l_partkey,
  {R4('(FGM + 0.5 * FG3M) / case when FGA > 0 then FGA else 1 end')} as efg_pct,
  {R4('TOV / case when FGA + 0.44 * FTA + TOV > 0 then FGA + 0.44 * FTA + TOV else 1 end')} as tov_pct,
  {R4('OREB / case when OREB + DREB > 0 then OREB + DREB else 1 end')} as oreb_pct,
  {R4('FTA / case when FGA > 0 then FGA else 1 end')} as ftr,
  {R4('POSS')} as poss,
  {R4('48 * POSS / mx')} as pace,
  {R4('100 * PTS / case when POSS > 0 then POSS else 1 end')} as off_rtg,
  {R4('PTS - PLUS_MINUS')} as opp_pts,
  {R4('100 * (PTS - PLUS_MINUS) / case when POSS > 0 then POSS else 1 end')} as def_rtg,
  {R4('100 * PTS / case when POSS > 0 then POSS else 1 end - 100 * (PTS - PLUS_MINUS) / case when POSS > 0 then POSS else 1 end')} as net_rtg,
  cast(PLUS_MINUS > 15 and WL = 'W' as int) as blowout_win,
  cast(abs(PLUS_MINUS) < 5 as int) as close_game
from c
""")
def team_ratings(spark, sf_dir):
    b = box_scores(spark, sf_dir)
    b = b.withColumns(R.team_ratios()).withColumn("POSS", R.possessions())
    b = with_entity_stats(b, ["l_suppkey"], __most=F.max("MIN")).withColumn("PACE", 48 * F.col("POSS") / F.col("__most"))
    b = b.withColumns(R.team_ratings()).withColumn("WIN", R.win_flag("WL"))
    names = {"EFG_PCT": "efg_pct", "TOV_PCT": "tov_pct", "OREB_PCT": "oreb_pct", "FTR": "ftr",
             "POSS": "poss", "PACE": "pace", "OFF_RTG": "off_rtg", "OPP_PTS": "opp_pts",
             "DEF_RTG": "def_rtg", "NET_RTG": "net_rtg"}
    return b.select(*KEYS, *[r4(k).alias(v) for k, v in names.items()],
                    R.blowout_win("PLUS_MINUS", "WIN").alias("blowout_win"),
                    R.close_game("PLUS_MINUS").alias("close_game"))


# ----------------------------------------------------------------- season_phase (C17)
@register("season_phase", "C17", """
select o_orderkey, cast(month(o_orderdate) as int) as month,
  cast(month(o_orderdate) in (10, 11, 12) as int) as early_season,
  cast(month(o_orderdate) in (1, 2, 3) as int) as mid_season,
  cast(month(o_orderdate) in (4, 5, 6) as int) as late_season,
  cast(month(o_orderdate) >= 10 or month(o_orderdate) <= 11 as int) as early_literal,
  cast(month(o_orderdate) >= 12 or month(o_orderdate) <= 2 as int) as mid_literal,
  cast(month(o_orderdate) >= 3 and month(o_orderdate) <= 4 as int) as late_literal,
  cast(month(o_orderdate) >= 5 as int) as playoffs_literal
from orders
""")
def season_phase(spark, sf_dir):
    o = orders_log(spark, sf_dir)
    d = cal.season_phase("o_orderdate")
    lit_ = cal.season_phase("o_orderdate", "service_literal")
    return o.select("o_orderkey", d["month"].cast("int").alias("month"),
                    d["early_season"].alias("early_season"), d["mid_season"].alias("mid_season"),
                    d["late_season"].alias("late_season"),
                    lit_["early_season"].alias("early_literal"), lit_["mid_season"].alias("mid_literal"),
                    lit_["late_season"].alias("late_literal"), lit_["playoffs"].alias("playoffs_literal"))


# ----------------------------------------------------------------- season_label
def _lab(y: str) -> str:
    return f"concat(cast({y} as varchar), '-', lpad(cast(({y} + 1) % 100 as varchar), 2, '0'))"


@register("season_label", "C18 C20", f"""
with b as (select o_orderkey, o_orderdate, year(o_orderdate) as y, month(o_orderdate) as m,
                  concat('2', cast(year(o_orderdate) as varchar)) as sid from orders)
select o_orderkey, sid as season_id,
  {_lab("case when m >= 10 then y else y - 1 end")} as season_from_date,
  {_lab("case when m >= 7 then y - 1 else y - 2 end")} as season_from_date_ref,
  {_lab("cast(substr(sid, 2, 4) as int)")} as season_from_id,
  {_lab("cast(substr(sid, 1, 4) as int)")} as season_from_id_ref,
  array_to_string(list_transform(range(y - 3 + 1, y + 1), lambda x: {_lab('x')}), ',') as last_3_seasons
from b
""")
def season_label(spark, sf_dir):
    o = orders_log(spark, sf_dir).withColumn(
        "season_id", F.concat(F.lit("2"), F.year("o_orderdate").cast("string")))
    lab_date = cal.season_label_from_date("o_orderdate")
    return o.select(
        "o_orderkey", "season_id", lab_date.alias("season_from_date"),
        cal.season_label_from_date("o_orderdate", "reference").alias("season_from_date_ref"),
        cal.season_label_from_id("season_id").alias("season_from_id"),
        cal.season_label_from_id("season_id", "reference").alias("season_from_id_ref"),
        F.array_join(cal.season_list(F.concat(F.year("o_orderdate").cast("string"), F.lit("-xx")), 3),
                     ",").alias("last_3_seasons"))


# ----------------------------------------------------------------- fill_values
@register("fill_values", "B2 B3 B4 B5", f"""
with b as ({BOX_SQL}),
c as (select *, case when FTA > 0 then FTM / FTA end as FT_PCT, nullif(FGA, 0) as FGA_N,
             case when MATCHUP is null then null else string_split(MATCHUP, ' ')[-1] end as OPP
      from b),
m as (select l_suppkey, OPP as mode_opp from (
        select l_suppkey, OPP, row_number() over (partition by l_suppkey order by count(*) desc, OPP) as r
        from c where OPP is not null group by l_suppkey, OPP) where r = 1)
select l_orderkey, l_linenumber, l_partkey,
  {R4('coalesce(FT_PCT, avg(FT_PCT) over (partition by c.l_suppkey))')} as ft_pct_filled,
  coalesce(FGA_N, 0) as fga_filled,
  coalesce(MATCHUP, 'UNK') as matchup_filled,
  coalesce(OPP, mode_opp, 'Unknown') as opponent_filled
from c left join m on c.l_suppkey = m.l_suppkey
""")
def fill_values(spark, sf_dir):
    b = box_scores(spark, sf_dir).withColumns({
        "FT_PCT": F.when(F.col("FTA") > 0, F.col("FTM") / F.col("FTA")),
        "FGA_N": F.nullif(F.col("FGA"), F.lit(0.0)),
        "OPP": F.when(F.col("MATCHUP").isNotNull(), F.element_at(F.split("MATCHUP", " "), -1)),
    })
    b = C.fill_mean(b, ["FT_PCT"], BOX)
    b = C.fill_zero(b, ["FGA_N"])
    b = C.fill_unknown(b, ["MATCHUP"])
    b = C.fill_mode(b, ["OPP"], by=["l_suppkey"])
    return b.select(*KEYS, r4("FT_PCT").alias("ft_pct_filled"), F.col("FGA_N").alias("fga_filled"),
                    F.col("MATCHUP").alias("matchup_filled"), F.col("OPP").alias("opponent_filled"))


# ----------------------------------------------------------------- ffill_bfill
_AS_OF = _dt.date(2024, 2, 1)


@register("ffill_bfill", "B6", """
with b as (select event_id, user_id, case when event_type = 'error' then null else ts end as t from events)
select event_id,
  epoch_us(coalesce(t,
    last_value(t ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row),
    first_value(t ignore nulls) over (partition by user_id order by event_id rows between current row and unbounded following),
    timestamp '2024-02-01 00:00:00')) as t_filled_us
from b
""")
def ffill_bfill(spark, sf_dir):
    ev = events_log(spark, sf_dir).withColumn(
        "t", F.when(F.col("event_type") == "error", F.lit(None)).otherwise(F.col("ts")))
    ev = C.ffill_bfill(ev, ["t"], by=["user_id"], order=["event_id"], as_of=_AS_OF)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")     # zone-free epoch micros
    return ev.select("event_id", F.timestamp_diff("MICROSECOND", epoch, F.col("t")).alias("t_filled_us"))


# ----------------------------------------------------------------- null_profile (B1)
_NP_COLS = {"value": "case when event_type = 'error' then null else value end",
            "props": "case when event_type = 'view' then null else props end",
            "event_type": "event_type", "ts": "ts"}


@register("null_profile", "B1", "\nunion all\n".join(
    f"select '{c}' as column_name, cast(count(*) - count({e}) as bigint) as null_count from events"
    for c, e in _NP_COLS.items()))
def null_profile(spark, sf_dir):
    ev = events_log(spark, sf_dir).select(*[F.expr(e).alias(c) for c, e in _NP_COLS.items()])
    return C.null_profile(ev).withColumnRenamed("column", "column_name")


# ----------------------------------------------------------------- gates
@register("warmup_trim", "B13", f"""
select l_orderkey, l_linenumber, l_partkey from (
  select l_orderkey, l_linenumber, l_partkey, row_number() over ({W_LI}) as rn,
         count(*) over (partition by l_suppkey) as n from lineitem)
where rn > greatest(10, floor(n * 0.1))
""")
def warmup_trim(spark, sf_dir):
    from perflog.plans.bindings import lineitem_log
    return C.warmup_trim(lineitem_log(spark, sf_dir), BOX, 10, 0.1).select(*KEYS)


@register("min_rows_gate", "B11 B12", """
select o_orderkey from (
  select o_orderkey, count(*) over (partition by o_custkey) as n from orders
  where o_totalprice is not null)
where n >= 10
""")
def min_rows_gate(spark, sf_dir):
    o = C.drop_incomplete(orders_log(spark, sf_dir), ["o_totalprice"])
    return C.min_rows_gate(o, ORDERS, 10).select("o_orderkey")


# ----------------------------------------------------------------- coerce_types
@register("coerce_types", "B7 B8 B9 B10", """
with b as (select event_id, props, value, ts,
                  upper(strftime(ts, '%b %d, %Y')) as date_text,
                  case when value > 50 then 'True' else 'False' end as flag_text,
                  case when event_type = 'error' then 'n/a' else cast(user_id as varchar) end as id_text
           from events)
select event_id,
  try_cast(regexp_extract(props, '(\\d+)', 1) as double) as k_num,
  cast(try_cast(id_text as bigint) as double) as user_id_parsed,
  coalesce(try_cast(id_text as double), 0.0) as id_or_zero,
  flag_text = 'True' as flag,
  strftime(cast(strptime(date_text, '%b %d, %Y') as date), '%Y-%m-%d') as day
from b
""")
def coerce_types(spark, sf_dir):
    ev = events_log(spark, sf_dir).withColumns({
        "date_text": F.upper(F.date_format("ts", "MMM dd, yyyy")),
        "flag_text": F.when(F.col("value") > 50, "True").otherwise("False"),
        "id_text": F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("user_id").cast("string")),
    })
    return ev.select(
        "event_id",
        P.to_double(F.regexp_extract("props", r"(\d+)", 1)).alias("k_num"),
        P.to_id("id_text").cast("double").alias("user_id_parsed"),  # nullable ids surface as double
        P.to_double_or_zero("id_text").alias("id_or_zero"),
        P.to_bool("flag_text").alias("flag"),
        F.date_format(P.parse_date("date_text"), "yyyy-MM-dd").alias("day"))


# ----------------------------------------------------------------- prediction_adjust
FACTORS = ("low_minutes", "high_minutes", "scorer_bonus", "playmaker_bonus", "rebounder_bonus")


def _adj_sql() -> str:
    bonus = "case when stat in ('PTS', 'AST', 'REB') then 0.05 else 0 end"
    return f"""
with b as ({BOX_SQL}),
c as (select l_orderkey, l_linenumber, l_partkey, MIN,
             case l_partkey % 5 when 0 then 'PTS' when 1 then 'AST' when 2 then 'REB' when 3 then 'STL' else 'TOV' end as stat,
             {roll_avg('l_extendedprice / 1000', 5, W_LI)} as raw from b)
select l_orderkey, l_linenumber, l_partkey, stat as model,
  case stat when 'PTS' then 'scorer' when 'AST' then 'playmaker' when 'REB' then 'rebounder' when 'STL' then 'defender' else 'all_around' end as role,
  case stat when 'PTS' then 'mid_range' when 'AST' then 'passing' when 'REB' then 'inside' when 'STL' then 'perimeter_defense' else 'balanced' end as emphasis,
  {R4(f"coalesce(greatest(0.0, round_even(raw * (1 + case when MIN < 20 then -0.15 when MIN > 35 then 0.1 else 0 end + {bonus}), 1)), 0.0)")} as value,
  {R4("case when raw is not null then greatest(0.0, raw - raw * 0.15) end")} as low,
  {R4("raw + raw * 0.15")} as high,
  case when MIN < 20 then -0.15 end as low_minutes,
  case when MIN >= 20 and MIN > 35 then 0.1 end as high_minutes,
  case when stat = 'PTS' then 0.05 end as scorer_bonus,
  case when stat = 'AST' then 0.05 end as playmaker_bonus,
  case when stat = 'REB' then 0.05 end as rebounder_bonus,
  case when raw > 0 then 'high' else 'low' end as confidence
from c
"""


@register("prediction_adjust", "C23 C24 C25 C26 C28 F6", _adj_sql())
def prediction_adjust(spark, sf_dir):
    """Each row predicts the stat that its part number names, so every role and the default occur."""
    stat = F.element_at(F.array(*map(F.lit, ("PTS", "AST", "REB", "STL", "TOV"))), (F.col("l_partkey") % 5 + 1).cast("int"))
    b = box_scores(spark, sf_dir).select("l_suppkey", "l_shipdate", *KEYS, "MIN", (F.col("l_extendedprice") / 1000).alias("price"))
    b = in_pieces(b, BOX, 5, lambda p: {"raw": Wn.rolling_mean("price", 5, p, True)}).withColumn("stat", stat)
    b = with_role_context(b, "stat")
    b = b.withColumn("adjustment_factors", PR.adjustment_factors("MIN", F.col("role"), "stat"))
    b = b.withColumns({"value": PR.adjusted_value("raw", F.col("adjustment_factors"), F.lit(True)),
                       "confidence_interval": PR.prediction_interval("raw"), "confidence": PR.confidence_label("raw")})
    flat = PR.flatten_predictions(b, list(FACTORS), "stat", keep=[*KEYS, "role", "emphasis", "confidence"])
    return flat.select(*KEYS, F.col("stat").alias("model"), "role", "emphasis", r4("value").alias("value"), r4("low").alias("low"),
                       r4("high").alias("high"), *FACTORS, "confidence")
