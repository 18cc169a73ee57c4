"""Window-operator queries over the driver tables, each with
its DuckDB oracle.  Every query runs over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from perflog.operators import windows as Wn
from perflog.operators.ranking import last_n
from perflog.operators.split import DAY, in_pieces, numbered, running_means
from perflog.plans.bindings import EVENTS, LINEITEM, ORDERS, events_log, lineitem_log, orders_log
from perflog.plans.registry import register
from perflog.plans.sqlbits import (R4, W_EV, W_LI, W_ORD, WL_SQL, prior_avg, r4, roll_avg, roll_std,
                                   roll_sum, rows)

# ----------------------------------------------------------------- recent_form
RECENT_FORM_SQL = f"""
with b as (select *, {WL_SQL} as wl from orders),
c as (
  select o_orderkey, o_custkey, o_orderdate, wl,
         {roll_avg('o_totalprice', 3, W_ORD)} as a3,
         coalesce(date_sub('day', lag(o_orderdate) over ({W_ORD}), o_orderdate), 3) as dr,
         row_number() over ({W_ORD}) as rn,
         case when row_number() over ({W_ORD}) = 1
                or (lag(wl) over ({W_ORD}) is distinct from wl)
              then row_number() over ({W_ORD}) end as st
  from b),
d as (select *, rn - max(st) over {rows(W_ORD, None, 0)} + 1 as streak from c)
select o_orderkey, o_custkey, {R4('a3')} as avg_3, cast(dr as int) as days_rest,
       cast(rn as int) as game_number,
       cast(case when wl = 'W' then streak else 0 end as int) as win_streak,
       cast(case when wl = 'L' then streak else 0 end as int) as loss_streak
from d
"""


def recent_form_df(o, **cut):
    o = o.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "WL")
    df = in_pieces(o, ORDERS, 2, lambda p: {"avg_3": r4(Wn.rolling_mean("o_totalprice", 3, p, True)),
                                            "days_rest": Wn.days_rest(p, 3, True, "o_orderdate")},
                   result="WL", keep=("__rn", "__run"), **cut)
    win, loss = Wn.streaks_of_run("WL")
    return df.select("o_orderkey", "o_custkey", "avg_3", "days_rest", F.col("__rn").cast("int").alias("game_number"),
                     win.alias("win_streak"), loss.alias("loss_streak"))


@register("recent_form", "D1 D8 D16 D17", RECENT_FORM_SQL)
def recent_form(spark, sf_dir):
    """Flagship: recent form of every customer's order log."""
    return recent_form_df(orders_log(spark, sf_dir))


@register("recent_form_split", "D1 D8 D16 D17", RECENT_FORM_SQL)
def recent_form_split(spark, sf_dir):
    """The same in small pieces (chunks of 90 days, buckets of 4 rows), so that borders, halos and
    carried runs meet the oracle at every size."""
    return recent_form_df(orders_log(spark, sf_dir), chunk_seconds=90 * DAY, rows_per_bucket=4)


# ----------------------------------------------------------------- rolling_mean_std
_TAX = "nullif(l_tax, 0)"   # a zero tax rate is recorded as missing: rolling nulls poison


@register("rolling_mean_std", "D1 D2", f"""
select l_orderkey, l_linenumber, l_partkey,
  {', '.join(f"{R4(roll_avg('l_quantity', n, W_LI))} as qty_avg_{n}, "
             f"{R4(roll_std('l_quantity', n, W_LI))} as qty_std_{n}, "
             f"{R4(roll_avg(_TAX, n, W_LI))} as tax_avg_{n}" for n in (3, 5, 10))}
from lineitem
""")
def rolling_mean_std(spark, sf_dir):
    s = LINEITEM
    li = lineitem_log(spark, sf_dir).withColumn("tax", F.expr(_TAX))
    li = li.select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "tax")

    def build(p):
        cols = {}
        for n in (3, 5, 10):
            cols[f"qty_avg_{n}"] = r4(Wn.rolling_mean("l_quantity", n, p, True))
            cols[f"qty_std_{n}"] = r4(Wn.rolling_std("l_quantity", n, p, True))
            cols[f"tax_avg_{n}"] = r4(Wn.rolling_mean("tax", n, p, True))
        return cols

    return in_pieces(li, s, 9, build).drop("l_suppkey", "l_shipdate", "l_quantity", "tax")


# ----------------------------------------------------------------- rolling_filled (D3)
_WE_ORD = "partition by o_custkey"


@register("rolling_filled", "D3", f"""
select o_orderkey,
  {', '.join(f"{R4(f'coalesce({roll_avg('o_totalprice', n, W_ORD)}, avg(o_totalprice) over ({_WE_ORD}))')} as price_avg_{n}, "
             f"{R4(f'coalesce({roll_std('o_totalprice', n, W_ORD)}, stddev_samp(o_totalprice) over ({_WE_ORD}))')} as price_std_{n}"
             for n in (3, 5, 10))}
from orders
""")
def rolling_filled(spark, sf_dir):
    s = ORDERS
    o = orders_log(spark, sf_dir)
    o = o.select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    means, stds = [f"price_avg_{n}" for n in (3, 5, 10)], [f"price_std_{n}" for n in (3, 5, 10)]
    o = in_pieces(o, s, 9, lambda p: {f"price_avg_{n}": Wn.rolling_mean("o_totalprice", n, p, True) for n in (3, 5, 10)}
                  | {f"price_std_{n}": Wn.rolling_std("o_totalprice", n, p, True) for n in (3, 5, 10)})
    o = Wn.fill_from_entity(o, s, dict.fromkeys(means, "o_totalprice"), dict.fromkeys(stds, "o_totalprice"))
    return o.select("o_orderkey", *[r4(c).alias(c) for c in means + stds])


# ----------------------------------------------------------------- ema
_EV_VALUE = "case when event_type <> 'error' then value end"   # error events carry no value


def _ema_sql(spans=(3, 5, 10)) -> str:
    parts = []
    for sp in spans:
        q = 1.0 - 2.0 / (sp + 1.0)
        wt = f"pow({q!r}, a.rn - b.rn)"
        parts.append(f"{R4(f'sum(b.v * {wt}) / sum(case when b.v is not null then {wt} end)')} as ema_{sp}")
    return f"""
with e as (select event_id, user_id, {_EV_VALUE} as v,
                  row_number() over ({W_EV}) as rn from events)
select a.event_id, {', '.join(parts)}
from e a join e b on a.user_id = b.user_id and b.rn <= a.rn
group by a.event_id
"""


@register("ema", "D4", _ema_sql())
def ema(spark, sf_dir):
    s = EVENTS
    ev = events_log(spark, sf_dir).withColumn("v", F.expr(_EV_VALUE))
    names = [f"ema_{sp}" for sp in (3, 5, 10)]
    ev = Wn.ewm(ev.select("event_id", "user_id", "ts", "v"), "v", {f"ema_{sp}": sp for sp in (3, 5, 10)}, s, 7 * DAY)
    return ev.select("event_id", *[r4(c).alias(c) for c in names])


# ----------------------------------------------------------------- cumulative_mean
@register("cumulative_mean", "D5", f"""
select event_id,
  {R4(f'avg({_EV_VALUE}) over {rows(W_EV, None, 0)}')} as value_cum_avg,
  {R4(f'avg(value) over {rows(W_EV, None, 0)}')} as value_cum_avg_all
from events
""")
def cumulative_mean(spark, sf_dir):
    s = EVENTS
    ev = events_log(spark, sf_dir).withColumn("v", F.expr(_EV_VALUE))
    ev = running_means(ev.select("event_id", "user_id", "ts", "v", "value"), s, {"a": "v", "b": "value"}, 7 * DAY)
    return ev.select("event_id", r4("a").alias("value_cum_avg"), r4("b").alias("value_cum_avg_all"))


# ----------------------------------------------------------------- diff_trend
@register("diff_trend", "D6 D7", f"""
with d as (select *, l_quantity - lag(l_quantity) over ({W_LI}) as qd from lineitem)
select l_orderkey, l_linenumber, l_partkey, {R4('qd')} as qty_diff,
       {R4(roll_avg('qd', 5, W_LI))} as qty_trend
from d
""")
def diff_trend(spark, sf_dir):
    s = LINEITEM
    li = lineitem_log(spark, sf_dir).select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    li = in_pieces(li, s, 5, lambda p: {"qty_diff": Wn.diff("l_quantity", p, 1, True)},
                   lambda p: {"qty_trend": Wn.rolling_mean("qty_diff", 5, p, True)})
    return li.select("l_orderkey", "l_linenumber", "l_partkey", r4("qty_diff").alias("qty_diff"),
                     r4("qty_trend").alias("qty_trend"))


# ----------------------------------------------------------------- streak_current
_EV_WL = "case event_type when 'purchase' then 'W' when 'error' then 'L' end"


@register("streak_current", "D8", f"""
with b as (select *, {_EV_WL} as wl from events),
c as (select event_id, user_id, ts, wl, row_number() over ({W_EV}) as rn,
             case when row_number() over ({W_EV}) = 1
                    or (lag(wl) over ({W_EV}) is distinct from wl)
                  then row_number() over ({W_EV}) end as st from b),
d as (select *, rn - max(st) over {rows(W_EV, None, 0)} + 1 as streak from c)
select event_id, cast(case when wl = 'W' then streak else 0 end as int) as win_streak,
       cast(case when wl = 'L' then streak else 0 end as int) as loss_streak
from d
""")
def streak_current(spark, sf_dir):
    ev = events_log(spark, sf_dir).withColumn("wl", F.expr(_EV_WL))
    ev = numbered(ev.select("event_id", "user_id", "ts", "wl"), EVENTS, "wl", 7 * DAY)
    win, loss = Wn.streaks_of_run("wl")
    return ev.select("event_id", win.alias("win_streak"), loss.alias("loss_streak"))


# ----------------------------------------------------------------- streak_entering
@register("streak_entering", "D9", f"""
with b as (select *, cast(o_orderstatus = 'F' as int) as win from orders),
c as (select o_orderkey, o_custkey, o_orderdate, win, row_number() over ({W_ORD}) as rn,
             case when row_number() over ({W_ORD}) = 1 or lag(win) over ({W_ORD}) <> win
                  then row_number() over ({W_ORD}) end as st from b),
d as (select *, rn - max(st) over {rows(W_ORD, None, 0)} + 1 as streak from c)
select o_orderkey,
  cast(coalesce(lag(case when win = 1 then streak else 0 end) over ({W_ORD}), 0) as int) as cum_win_streak,
  cast(coalesce(lag(case when win = 0 then streak else 0 end) over ({W_ORD}), 0) as int) as cum_loss_streak
from d
""")
def streak_entering(spark, sf_dir):
    o = orders_log(spark, sf_dir)
    o = o.select("o_custkey", "o_orderdate", "o_orderkey", "WIN")
    win, loss = Wn.streaks_of_run("WIN", "__run", 1, 0)
    o = in_pieces(o, ORDERS, 1, lambda p: {"cum_win_streak": Wn.lagged(win, 1, p, 0, True).cast("int"),
                                           "cum_loss_streak": Wn.lagged(loss, 1, p, 0, True).cast("int")}, result="WIN")
    return o.select("o_orderkey", "cum_win_streak", "cum_loss_streak")


# ----------------------------------------------------------------- win_pct
_WIN_SQL = "cast(o_orderstatus = 'F' as int)"


@register("win_pct", "D10 D11 D15", f"""
with b as (select *, {_WIN_SQL} as win from orders)
select o_orderkey,
  {', '.join(f"{R4(roll_avg('win', n, W_ORD))} as win_pct_{n}" for n in (5, 10, 20))},
  {', '.join(f"cast({roll_sum('win', n, W_ORD)} as double) as win_count_{n}" for n in (3, 5, 10))},
  {', '.join(f"{R4(f'coalesce({prior_avg('win', n, W_ORD)}, 0.5)')} as prior_win_pct_{n}" for n in (5, 10, 20))}
from b
""")
def win_pct(spark, sf_dir):
    s = ORDERS
    o = orders_log(spark, sf_dir)
    o = o.select("o_custkey", "o_orderdate", "o_orderkey", "WIN")

    def build(p):
        cols = {}
        for n in (5, 10, 20):
            cols[f"win_pct_{n}"] = r4(Wn.rolling_mean("WIN", n, p, True))
        for n in (3, 5, 10):
            cols[f"win_count_{n}"] = Wn.rolling_sum("WIN", n, p, True).cast("double")
        for n in (5, 10, 20):
            cols[f"prior_win_pct_{n}"] = r4(Wn.prior_mean("WIN", n, p, 0.5, True))
        return cols

    return in_pieces(o, s, 20, build).drop("o_custkey", "o_orderdate", "WIN")


# ----------------------------------------------------------------- momentum
_PM = "(l_quantity - 25.5)"   # a centred, signed per-row margin


@register("momentum", "D12 D13", f"""
with b as (select *, {_PM} as pm from lineitem),
c as (select *, {prior_avg('pm', 3, W_LI)} as p3 from b),
d as (select *, coalesce(p3 - lag(p3) over ({W_LI}), 0) as pm_trend from c)
select l_orderkey, l_linenumber, l_partkey,
  {', '.join(f"{R4(f'coalesce({prior_avg('pm', n, W_LI)}, 0)')} as pm_avg_{n}" for n in (3, 5, 10))},
  {R4('pm_trend')} as pm_trend,
  cast(pm_trend > 5 as int) as positive_momentum, cast(pm_trend < -5 as int) as negative_momentum
from d
""")
def momentum(spark, sf_dir):
    s = LINEITEM
    li = lineitem_log(spark, sf_dir).withColumn("pm", F.expr(_PM))
    li = li.select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "pm")
    li = in_pieces(li, s, 10, lambda p: {f"pm_avg_{n}": r4(Wn.prior_mean("pm", n, p, 0.0, True)) for n in (3, 5, 10)}
                   | {"before": Wn.prior_mean("pm", 3, p, None, True)},
                   lambda p: {"pm_trend": Wn.momentum_of("before", p, True)})
    up, down = Wn.momentum_flags("pm_trend")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "pm_avg_3", "pm_avg_5", "pm_avg_10",
                     r4("pm_trend").alias("pm_trend"), up.alias("positive_momentum"), down.alias("negative_momentum"))


# ----------------------------------------------------------------- lagged_outcomes
@register("lagged_outcomes", "D14", f"""
with b as (select *, {_WIN_SQL} as win from orders)
select o_orderkey, cast(coalesce(lag(win, 1) over ({W_ORD}), 0) as int) as prev_game_win,
  {', '.join(f"cast(coalesce(lag(win, {k}) over ({W_ORD}), 0) as int) as won_{k}_ago" for k in range(1, 6))}
from b
""")
def lagged_outcomes(spark, sf_dir):
    s = ORDERS
    o = orders_log(spark, sf_dir)
    o = in_pieces(o.select("o_custkey", "o_orderdate", "o_orderkey", "WIN"), s, 5,
                  lambda p: {f"won_{k}_ago": Wn.lagged("WIN", k, p, 0, True).cast("int") for k in range(1, 6)})
    return o.select("o_orderkey", F.col("won_1_ago").alias("prev_game_win"), *[f"won_{k}_ago" for k in range(1, 6)])


# ----------------------------------------------------------------- days_rest
@register("days_rest", "D16 D17 C16", f"""
with b as (select event_id, cast(coalesce(date_sub('day', lag(ts) over ({W_EV}), ts), 3) as int) as dr,
                  cast(row_number() over ({W_EV}) as int) as game_number from events)
select event_id, dr as days_rest, game_number,
  cast(dr <= 1 as int) as back_to_back, cast(dr = 0 as int) as no_rest,
  cast(dr > 0 and dr <= 1 as int) as short_rest, cast(dr > 1 and dr <= 3 as int) as normal_rest,
  cast(dr > 3 as int) as extended_rest,
  case when dr = 0 then 'none' when dr <= 1 then 'short' when dr <= 3 then 'normal' else 'extended' end as rest_bucket
from b
""")
def days_rest(spark, sf_dir):
    from perflog.functions.calendar import rest_flags
    s = EVENTS
    ev = in_pieces(events_log(spark, sf_dir).select("event_id", "user_id", "ts"), s, 1,
                   lambda p: {"days_rest": Wn.days_rest(p, 3, True, "ts"), "game_number": F.col("__rn").cast("int")}, chunk_seconds=7 * DAY)
    ev = ev.withColumns(rest_flags(F.col("days_rest")))
    return ev.select("event_id", "days_rest", "game_number", "back_to_back", "no_rest", "short_rest",
                     "normal_rest", "extended_rest", "rest_bucket")


# ----------------------------------------------------------------- zscore
_WE_LI = "partition by l_suppkey"


def _z_sql(x: str) -> str:
    return (f"case when stddev_samp({x}) over ({_WE_LI}) > 0 then ({x} - avg({x}) over ({_WE_LI})) "
            f"/ stddev_samp({x}) over ({_WE_LI}) end")


@register("zscore", "D19", f"""
select l_orderkey, l_linenumber, l_partkey, {R4(_z_sql('l_quantity'))} as qty_zscore,
       {R4(_z_sql('l_extendedprice'))} as price_zscore
from lineitem
""")
def zscore(spark, sf_dir):
    s = LINEITEM
    li = lineitem_log(spark, sf_dir)
    li = Wn.zscore(li, ["l_quantity", "l_extendedprice"], s)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", r4("l_quantity_ZSCORE").alias("qty_zscore"),
                     r4("l_extendedprice_ZSCORE").alias("price_zscore"))


# ----------------------------------------------------------------- last_n
@register("last_n", "G2", f"""
select o_custkey, o_orderkey, cast(rk as int) as recency_rank from (
  select o_custkey, o_orderkey,
         row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rk
  from orders) where rk <= 3
""")
def last_n_orders(spark, sf_dir):
    o = orders_log(spark, sf_dir, ["o_custkey", "o_orderkey", "o_orderdate"])
    return last_n(o, ORDERS, 3, rank_col="recency_rank").select("o_custkey", "o_orderkey", "recency_rank")
