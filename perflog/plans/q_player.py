"""Player-game training set to the end: information with a
numeric target, the set itself, the fitted feature chain and scoring rows by it, each with its oracle."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from perflog.models import chain as CH
from perflog.models import information as I
from perflog.models import trees as T
from perflog.plans import training as TR
from perflog.plans.bindings import BOX, BOX_SQL, box_scores
from perflog.plans.q_lookups import team_dimension
from perflog.plans.registry import register
from perflog.plans.sqlbits import R4, W_LI, r4, roll_avg, roll_std
from perflog.session import checkpoint_dir, for_wide_rows
from perflog.sources.store import read_through
from perflog.sources.tables import read_table

KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]
TRAIN = "(((l_orderkey * 31 + l_linenumber * 17 + l_partkey) % 1000003) * 7919) % 100 < 80"
BINS, K = 10, 3
STATS = ["MIN", "AST", "REB", "STL", "BLK", "TOV", "FGM", "FGA", "FG3M", "FG3A", "FTM", "FTA"]
FEATS = [*STATS, "l_extendedprice", "l_discount"]


def digamma_sql(n: str) -> str:
    steps = " - ".join(f"1 / (({n}) + {i})" for i in range(6))
    y = f"(({n}) + 6.0)"
    return f"(ln({y}) - 1 / (2 * {y}) - 1 / (12 * pow({y}, 2)) + 1 / (120 * pow({y}, 4)) - 1 / (252 * pow({y}, 6)) - {steps})"


def information_sql(k: int = K) -> str:
    """CTEs from p (feature, v, cls, n: rows by distinct value and class) to mi (feature, mi)."""
    w = "(partition by feature, cls order by v)"
    near = ", ".join(f"[abs({f}(v, {j}) over {w} - v), cast({f}(n, {j}) over {w} as double)]" for j in range(1, k + 1) for f in ("lag", "lead"))
    return f"""nc as (select feature, cls, sum(n) as size from p group by all),
q as (select p.*, size, least({k}, size - 1) as near from p join nc using (feature, cls) where size > 1),
ne as (select feature, cls, v, near, unnest([[0.0, cast(n - 1 as double)], {near}]) as e from q),
nd as (select feature, cls, v, near, e[1] as d, sum(e[2]) over (partition by feature, cls, v order by e[1], e[2] rows unbounded preceding) as upto
       from ne where e[1] is not null),
ds as (select feature, cls, v, min(d) as d from nd where upto >= near group by all),
t as (select feature, v, sum(n) as t from q group by all),
cu as (select feature, v, sum(t) over (partition by feature order by v) as upto from t),
g as (select q.feature, q.v, q.cls, q.n, q.size, q.near, ds.d, q.v + ds.d as hi, q.v - ds.d as lo from q join ds using (feature, cls, v)),
gh as (select g.*, coalesce(cu.upto, 0) as below from g asof left join cu on g.feature = cu.feature and g.hi > cu.v),
gl as (select gh.*, coalesce(cu.upto, 0) as upto from gh asof left join cu on gh.feature = cu.feature and gh.lo >= cu.v),
gm as (select gl.*, greatest(n, case when d > 0 then below - upto else t end) as m from gl join t using (feature, v)),
mi as (select feature, greatest(0.0, sum(n * ({digamma_sql('case when d > 0 then near else n end')} - {digamma_sql('m')} - {digamma_sql('size')})) / sum(n)
         + {digamma_sql('sum(n)')}) as mi from gm group by feature)"""


def classes_sql(rows: str, y: str) -> str:
    """CTE yc (y, cls): equal-frequency classes of a numeric target."""
    return f"""yc as (select y, cast(floor({BINS} * before / total) as int) as cls from (
  select y, sum(c) over (order by y) - c as before, sum(c) over () as total
  from (select {y} as y, count(*) as c from {rows} where {y} is not null group by 1)))"""


# ----------------------------------------------------------------- points_information
@register("points_information", "I3", f"""
with b as ({BOX_SQL}), {classes_sql('b', 'PTS')},
l as ({' union all '.join(f"select '{f}' as feature, cast({f} as double) as v, PTS as y from b" for f in FEATS)}),
p as (select feature, v, cls, count(*) as n from l join yc using (y) where v is not null group by all),
{information_sql()},
vb as (select feature, v, floor({BINS} * (sum(c) over (partition by feature order by v) - c) / sum(c) over (partition by feature)) as xb
       from (select feature, v, sum(n) as c from p group by all)),
c as (select feature, xb, cls, sum(n) as nxy from p join vb using (feature, v) group by all),
n as (select *, sum(nxy) over (partition by feature) as n, sum(nxy) over (partition by feature, xb) as nx, sum(nxy) over (partition by feature, cls) as ny from c),
bi as (select feature, greatest(0.0, sum(nxy / n * ln(nxy * n / (nx * ny)))) as mi from n group by feature)
select feature, {R4('mi.mi')} as by_neighbours, {R4('bi.mi')} as by_bins from mi join bi using (feature)
""")
def points_information(spark, sf_dir):
    """Information of box-score columns with points: by nearest neighbours and by equal-frequency cuts."""
    counts = I.labelled_counts(box_scores(spark, sf_dir), FEATS, "PTS", BINS)
    a, b = I.neighbour_information(counts, K), I.binned_information(counts, BINS)
    return a.select("feature", r4("mutual_info").alias("by_neighbours")).join(b.select("feature", r4("mutual_info").alias("by_bins")), "feature")


# ----------------------------------------------------------------- player_game_set (App. A)
NAMES = TR.player_game_names(STATS[1:], "PTS")
INTS = {"HOME", "DAYS_REST", "NO_REST", "SHORT_REST", "NORMAL_REST", "EXTENDED_REST", "BACK_TO_BACK", "EARLY_SEASON", "MID_SEASON",
        "LATE_SEASON", "OPP_STRENGTH"}


def set_sql() -> str:
    """CTEs up to ps (keys, features, OPPONENT, TARGET)."""
    horizon, ema = 200, []
    for n in TR.WINDOWS:
        w = f"pow({1 - 2 / (n + 1)!r}, a.rn - b.rn)"
        ema.append(f"sum(b.PTS * {w}) / sum({w}) as PTS_EMA_{n}")
    cols = []
    for n in TR.WINDOWS:
        cols += [f"coalesce({roll_avg('PTS', n, W_LI)}, avg(PTS) over (partition by l_suppkey)) as PTS_AVG_{n}",
                 f"coalesce({roll_std('PTS', n, W_LI)}, stddev_samp(PTS) over (partition by l_suppkey)) as PTS_STD_{n}"]
    cols += [f"coalesce({roll_avg(x, n, W_LI)}, avg({x}) over (partition by l_suppkey)) as {x}_AVG_{n}" for x in ("TS_PCT", "USAGE_RATE", *STATS[1:]) for n in (5, 10)]
    return f"""b as ({BOX_SQL}),
c as (select *, case when FGA + 0.44 * FTA > 0 then PTS / (2 * (FGA + 0.44 * FTA)) else 0.0 end as TS_PCT, FGA + 0.44 * FTA + TOV as USAGE_RATE,
  coalesce(cast(contains(MATCHUP, 'vs.') as int), 0) as HOME, coalesce(replace(string_split(MATCHUP, ' ')[-1], '@', ''), 'None') as OPPONENT,
  row_number() over ({W_LI}) as rn from b),
em as (select a.l_suppkey, a.rn, {', '.join(ema)} from c a join c b on a.l_suppkey = b.l_suppkey and b.rn between a.rn - {horizon} and a.rn group by a.l_suppkey, a.rn),
w as (select *, cast(coalesce(date_sub('day', lag(l_shipdate) over ({W_LI}), l_shipdate), 3) as int) as DAYS_REST, {', '.join(cols)} from c),
r as (select w.*, PTS_EMA_3, PTS_EMA_5, PTS_EMA_10, cast(DAYS_REST = 0 as int) as NO_REST, cast(DAYS_REST > 0 and DAYS_REST <= 1 as int) as SHORT_REST,
  cast(DAYS_REST > 1 and DAYS_REST <= 3 as int) as NORMAL_REST, cast(DAYS_REST > 3 as int) as EXTENDED_REST, cast(DAYS_REST <= 1 as int) as BACK_TO_BACK,
  cast(month(l_shipdate) in (10, 11, 12) as int) as EARLY_SEASON, cast(month(l_shipdate) in (1, 2, 3) as int) as MID_SEASON,
  cast(month(l_shipdate) in (4, 5, 6) as int) as LATE_SEASON, cast(coalesce(n_regionkey + 1, 3) as int) as OPP_STRENGTH, PTS as TARGET
  from w join em using (l_suppkey, rn) left join nation on OPPONENT = 'N' || cast(n_nationkey as varchar)),
k as (select * from r where {' and '.join(f"{c} is not null" for c in [*NAMES, 'TARGET'])}),
ps as (select * from (select *, count(*) over (partition by l_suppkey) as left_over from k) where left_over >= 3)"""


def player_set(spark, sf_dir):
    return TR.player_game_set(box_scores(for_wide_rows(spark), sf_dir), BOX, team_dimension(spark, sf_dir))


@register("player_game_set", "App.A D1 D2 D3 D4 C3 C6 C8 C16 C17 F1 B11 B12", f"""
with {set_sql()}
select {', '.join(KEYS)}, {', '.join(c if c in INTS else f"{R4(c)} as {c}" for c in NAMES)}, OPPONENT, {R4('TARGET')} as TARGET from ps
""")
def player_game_set(spark, sf_dir):
    return player_set(spark, sf_dir).select(*KEYS, *[F.col(c).cast("int").alias(c) if c in INTS else r4(c).alias(c) for c in NAMES], "OPPONENT", r4("TARGET").alias("TARGET"))


# ----------------------------------------------------------------- player_game_chain
def chain_sql() -> str:
    """CTEs from ps to ch (feature, category, at, mean, std): the chain fitted on the training rows."""
    at = " ".join(f"when '{f}' then {i}" for i, f in enumerate(NAMES))
    return f"""tr as (select {', '.join(f"cast({c} as double) as {c}" for c in NAMES)}, OPPONENT, TARGET as y from ps where {TRAIN}),
{classes_sql('tr', 'y')},
un as (unpivot tr on {', '.join(NAMES)} into name feature value v),
l as (select feature, v, y, null as category from un union all
      select 'OPP_' || o as feature, cast(OPPONENT = o as double) as v, y, o as category from tr, (select distinct OPPONENT as o from tr)),
p as (select feature, v, cls, count(*) as n from l join yc using (y) group by all),
{information_sql()},
mo as (select feature, category, avg(v) as mean, stddev_pop(v) as std, case when category is null then case feature {at} end else {NAMES.index('OPP_STRENGTH')} + 0.5 end as pos
       from l group by feature, category),
ch as (select feature, category, mean, case when std > 0 then std else 1 end as std from (
         select *, row_number() over (order by round(coalesce(mi, 0), 8) desc, pos, feature) as rank from mo left join mi using (feature)) where rank <= 20)"""


def _half_key():
    return F.col("l_orderkey") * 31 + F.col("l_linenumber") * 17 + F.col("l_partkey")


def _kept_at(spark, sf_dir, what: str) -> str:
    where = hashlib.sha256(sf_dir.rstrip("/").encode()).hexdigest()[:16]
    return f"{checkpoint_dir(spark)}/{what}/{spark.sparkContext.applicationId}/{where}"


def stored_halves(spark, sf_dir):
    """(training rows, test rows) of the set; made once and stored, compressed, by the first query of an application."""
    def made():
        # rows of neither half (a null key) are none of the queries'
        rows = player_set(spark, sf_dir).select(*KEYS, *NAMES, "TARGET", "OPPONENT")
        return rows.withColumn("train", T.in_training(_half_key())).where("train is not null")

    stored = read_through(spark, _kept_at(spark, sf_dir, "sets"), made)
    return stored.where("train").drop("train"), stored.where("not train").drop("train")


def chain_of(spark, sf_dir):
    """The chain of the training rows; fitted and stored by the first query of an application, read by the others."""
    def fit():
        # read by every step of the fit
        train = stored_halves(spark, sf_dir)[0].select(*NAMES, "TARGET", "OPPONENT")
        return CH.fit_chain(train, NAMES, "TARGET", "OPPONENT", after="OPP_STRENGTH", k=20, bins=BINS, neighbours=K)

    return CH.stored_chain(spark, _kept_at(spark, sf_dir, "chains"), "1", fit)


_VALUE = " ".join(f"when '{c}' then cast({c} as double)" for c in NAMES)


@register("player_game_chain", "App.A I1 I2 I3 I8 B16", f"""
with {set_sql()}, {chain_sql()}
select {', '.join(KEYS)}, feature, {R4(f"(case when category is not null then cast(OPPONENT = category as double) else case feature {_VALUE} end end - mean) / std")} as value
from ps, ch where not ({TRAIN})
""")
def player_game_chain(spark, sf_dir):
    """Test rows through the chain fitted on the training rows: the 20 features that tell most about points, scaled."""
    chain, test = chain_of(spark, sf_dir), stored_halves(spark, sf_dir)[1]
    out = CH.named_values(CH.apply_chain(test, chain, NAMES, "OPPONENT"), chain, KEYS)
    return out.select(*KEYS, "feature", r4("value").alias("value"))


# ----------------------------------------------------------------- next_game_vector (C27 by the chain)
_NEXT_VALUE = {f"PTS_{k}_{n}": "p * 0.1" if k == "STD" else "p" for n in TR.WINDOWS for k in ("AVG", "STD", "EMA")}
_NEXT_VALUE |= {x: v for f, v in (("TS_PCT", "ts"), ("USAGE_RATE", "us")) for x in (f, f"{f}_AVG_5", f"{f}_AVG_10")}
_NEXT_VALUE |= {f"{s}_AVG_{n}": f"a_{s}" for s in STATS[1:] for n in (5, 10)}
_NEXT_VALUE |= {"MIN": "a_MIN", "HOME": "home", "DAYS_REST": "rest", "NO_REST": "cast(rest = 0 as int)", "SHORT_REST": "cast(rest > 0 and rest <= 1 as int)",
                "NORMAL_REST": "cast(rest > 1 and rest <= 3 as int)", "EXTENDED_REST": "cast(rest > 3 as int)", "BACK_TO_BACK": "cast(rest <= 1 as int)",
                "EARLY_SEASON": "0", "MID_SEASON": "1", "LATE_SEASON": "0", "OPP_STRENGTH": "coalesce(n_regionkey + 1, 3)"}


@register("next_game_vector", "C27 I1 I2 I3 B16", f"""
with {set_sql()}, {chain_sql()},
av as (select l_suppkey, avg(PTS) as p, {', '.join(f"avg({s}) as a_{s}" for s in STATS)}, max(l_shipdate) as last from b group by l_suppkey),
rq as (select s_suppkey, 'N' || cast(s_suppkey % 30 as varchar) as opp, s_suppkey % 2 as home from supplier),
j as (select *, cast(date_sub('day', last, timestamp '2030-01-01 00:00:00') as int) as rest,
        case when a_FGA + 0.44 * a_FTA > 0 then p / (2 * (a_FGA + 0.44 * a_FTA)) else 0 end as ts, a_FGA + 0.44 * a_FTA + a_TOV as us
      from rq join av on s_suppkey = l_suppkey left join nation on opp = 'N' || cast(n_nationkey as varchar))
select l_suppkey, feature, {R4("(case when category is not null then cast(opp = category as double) else case feature " + " ".join(
    f"when '{c}' then cast({_NEXT_VALUE[c]} as double)" for c in NAMES) + " end end - mean) / std")} as value
from j, ch
""")
def next_game_vector(spark, sf_dir):
    """Every supplier's next-game row through the chain that the training rows fitted."""
    s = read_table(spark, sf_dir, "supplier")
    requests = s.select(F.col("s_suppkey").alias("l_suppkey"), F.lit("2030-01-01 00:00:00").cast("timestamp_ntz").alias("GAME_DATE"),
                        F.concat(F.lit("N"), (F.col("s_suppkey") % 30).cast("string")).alias("OPPONENT"), (F.col("s_suppkey") % 2).alias("IS_HOME"))
    rows = TR.next_game_row(box_scores(spark, sf_dir), BOX, requests, [], team_dimension(spark, sf_dir))
    chain = chain_of(spark, sf_dir)
    out = CH.named_values(CH.apply_chain(rows, chain, NAMES, "OPPONENT"), chain, ["l_suppkey"])
    return out.select("l_suppkey", "feature", r4("value").alias("value"))
