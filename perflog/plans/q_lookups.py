"""Lookup and opponent-strength queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from perflog.functions import parsing as P
from perflog.operators import lookups as L
from perflog.plans.bindings import BOX, BOX_SQL, box_scores, orders_log
from perflog.plans.registry import register
from perflog.plans.sqlbits import R4, W_LI, roll_avg
from perflog.sources.tables import read_table

_OPP_SQL = """case when MATCHUP is null then null
       when contains(MATCHUP, 'vs.') then string_split(MATCHUP, 'vs. ')[-1]
       when contains(MATCHUP, '@') then string_split(MATCHUP, '@ ')[-1]
       else string_split(MATCHUP, ' ')[-1] end"""


def team_dimension(spark, sf_dir):
    """Team dimension derived from nation: abbreviation ``N<k>``, full name,
    strength 1..5 from the region.  Opponents N25..N29 are absent on purpose."""
    n = read_table(spark, sf_dir, "nation")
    return n.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("abbreviation"),
                    F.col("n_name").alias("full_name"),
                    (F.col("n_regionkey") + 1).cast("int").alias("strength"))


# ----------------------------------------------------------------- lookup_default
@register("lookup_default", "F1 F4", f"""
with b as ({BOX_SQL}), c as (select l_orderkey, l_linenumber, l_partkey, {_OPP_SQL} as opponent from b),
t as (select 'N' || cast(n_nationkey as varchar) as abbreviation, n_name as full_name,
             cast(n_regionkey + 1 as int) as strength from nation)
select l_orderkey, l_linenumber, l_partkey, opponent, cast(coalesce(t.strength, 3) as int) as opp_strength,
       coalesce(t.full_name, 'UNKNOWN') as opp_name
from c left join t on c.opponent = t.abbreviation
""")
def lookup_default(spark, sf_dir):
    b = box_scores(spark, sf_dir).withColumn("opponent", P.opponent("MATCHUP"))
    dim = team_dimension(spark, sf_dir)
    b = L.lookup_defaults(b, dim, "opponent", "abbreviation", {"opp_strength": ("strength", 3), "opp_name": ("full_name", "UNKNOWN")})
    return b.select("l_orderkey", "l_linenumber", "l_partkey", "opponent", F.col("opp_strength").cast("int"), "opp_name")


# ----------------------------------------------------------------- opponent_strength_prior
@register("opponent_strength_prior", "F2 D18 D16", f"""
with b as ({BOX_SQL}),
c as (select * replace (l_shipdate + to_hours(l_linenumber % 3 * 6) as l_shipdate), {_OPP_SQL} as OPP, l_shipdate + to_hours(l_linenumber % 3 * 6) as d from b),
daily as (select OPP, d, sum(cast(WL = 'L' as bigint)) as w, count(*) as g
          from c where OPP is not null group by OPP, d),
prior as (select OPP, d,
            sum(w) over (partition by OPP order by d rows between unbounded preceding and 1 preceding) as pw,
            sum(g) over (partition by OPP order by d rows between unbounded preceding and 1 preceding) as pg
          from daily),
j as (select c.*, coalesce(case when p.pg > 0 then p.pw / p.pg end, 0.5) as OPP_STRENGTH,
             cast(coalesce(date_sub('day', lag(l_shipdate) over ({W_LI}), l_shipdate), 3) as int) as DAYS_REST
      from c left join prior p on c.OPP = p.OPP and c.d = p.d)
select l_orderkey, l_linenumber, l_partkey, {R4('OPP_STRENGTH')} as opp_strength,
  {R4(f"coalesce({roll_avg('OPP_STRENGTH', 5, W_LI)}, 0.5)")} as sos_5,
  {R4(f"coalesce({roll_avg('OPP_STRENGTH', 10, W_LI)}, 0.5)")} as sos_10,
  DAYS_REST as days_rest, DAYS_REST - 2 as rest_advantage, cast(DAYS_REST <= 1 as int) as back_to_back,
  cast(DAYS_REST >= 3 as int) as extra_rest
from j
""")
def opponent_strength_prior(spark, sf_dir):
    s = BOX
    b = box_scores(spark, sf_dir).withColumn("OPP", P.opponent("MATCHUP"))
    # three games a day: those of the same day count if they were played earlier
    hours = F.make_dt_interval(hours=F.col("l_linenumber") % 3 * 6)
    b = b.select("l_suppkey", (F.col("l_shipdate") + hours).alias("l_shipdate"), "l_orderkey", "l_linenumber", "l_partkey", "OPP", "WL")
    b = L.opponent_prior_win_rate(b, s, "OPP", F.col("WL") == "L")
    b = L.schedule_strength(b, s)
    return b.select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("OPP_STRENGTH").cast("decimal(38,8)"), 4)
                    .cast("double").alias("opp_strength"),
                    *[F.round(F.col(f"SOS_{n}").cast("decimal(38,8)"), 4).cast("double").alias(f"sos_{n}")
                      for n in (5, 10)],
                    F.col("DAYS_REST").alias("days_rest"), F.col("REST_ADVANTAGE").alias("rest_advantage"),
                    F.col("BACK_TO_BACK").alias("back_to_back"), F.col("EXTRA_REST").alias("extra_rest"))


# ----------------------------------------------------------------- name_lookup
@register("name_lookup", "F3 F4", """
with named as (select o.o_orderkey, c.c_name, c.c_nationkey from orders o join customer c on o.o_custkey = c.c_custkey)
select named.o_orderkey, c2.c_custkey as customer_id, coalesce(n.n_name, 'UNKNOWN') as nation_name
from named join customer c2 on named.c_name = c2.c_name
left join nation n on named.c_nationkey = n.n_nationkey
""")
def name_lookup(spark, sf_dir):
    o = orders_log(spark, sf_dir, ["o_orderkey", "o_custkey"])
    cust = read_table(spark, sf_dir, "customer")
    named = o.join(cust.select("c_custkey", "c_name", "c_nationkey"), o.o_custkey == cust.c_custkey) \
             .select("o_orderkey", "c_name", "c_nationkey")
    resolved = L.resolve_ids(named, cust, "c_name", "c_name", "c_custkey", out="customer_id")
    nat = read_table(spark, sf_dir, "nation")
    out = L.lookup_default(resolved, nat, "c_nationkey", "n_nationkey", "n_name", "UNKNOWN", out="nation_name")
    return out.select("o_orderkey", "customer_id", "nation_name")
