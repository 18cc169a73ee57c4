"""Landing files: tables written as json lines and csv, some records damaged by a rule, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from perflog.plans.registry import register
from perflog.session import checkpoint_dir
from perflog.sources import landing as L
from perflog.sources.tables import read_table


def _folder(spark):
    return f"{checkpoint_dir(spark)}/landing-{uuid.uuid4().hex}"


def _as_json(df, cols, damaged, path):
    """Json lines; damaged ones are cut off in the middle."""
    line = F.to_json(F.struct(*cols))
    df.select(F.when(damaged, F.substring(line, 1, 20)).otherwise(line).alias("value")).write.text(path)


_CUST, _SUPP = "c_custkey % 11 = 4", "s_suppkey % 13 = 5"


def _players(spark, sf_dir):
    c, s = read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "supplier")
    base = _folder(spark)
    _as_json(c, [F.col("c_name").alias("PLAYER"), F.col("c_custkey").alias("PLAYER_ID"), F.col("c_nationkey").alias("TEAM_ID")], F.expr(_CUST), f"{base}/roster")
    _as_json(s, [F.col("s_suppkey").alias("id"), F.col("s_name").alias("full_name"), F.col("s_nationkey").alias("team_id")], F.expr(_SUPP), f"{base}/player")
    return L.read_players(spark, {"roster": f"{base}/roster", "player": f"{base}/player"})


@register("landing_players", "A1 A2", f"""
select c_custkey as id, c_name as name, cast(c_nationkey as bigint) as team_id from customer where not ({_CUST})
union all select s_suppkey, s_name, cast(s_nationkey as bigint) from supplier where not ({_SUPP})
""")
def landing_players(spark, sf_dir):
    """Both player shapes from json landing files; lines that are cut off are left out."""
    return _players(spark, sf_dir)[0]


@register("landing_quality", "A1 A2 A3", f"""
select 'info' as source, count(*) filter (where not (o_orderkey % 17 = 3)) as good, count(*) filter (where o_orderkey % 17 = 3) as bad from orders
union all select 'players', (select count(*) from customer where not ({_CUST})) + (select count(*) from supplier where not ({_SUPP})),
  (select count(*) from customer where {_CUST}) + (select count(*) from supplier where {_SUPP})
union all select 'teams', count(*), 0 from nation
""")
def landing_quality(spark, sf_dir):
    """Good and set-aside records of each kind of landing file; the bad ones go to a table of their own and are counted there."""
    base = _folder(spark)
    good, bad = _players(spark, sf_dir)
    o = read_table(spark, sf_dir, "orders")
    # csv: a text where the number belongs
    o.select(F.when(F.col("o_orderkey") % 17 == 3, F.lit("n/a")).otherwise(F.col("o_orderkey").cast("string")).alias("PERSON_ID"),
             F.col("o_orderpriority").alias("DISPLAY_FIRST_LAST"), F.col("o_orderstatus").alias("POSITION"), F.lit("6-6").alias("HEIGHT"),
             F.col("o_custkey").cast("string").alias("TEAM_ID")).write.option("header", True).csv(f"{base}/info")
    info, wrong = L.read_player_info(spark, f"{base}/info", o.select(F.col("o_orderkey").alias("id")), "csv")
    n = read_table(spark, sf_dir, "nation")
    _as_json(n, [F.col("n_nationkey").alias("id"), F.col("n_name").alias("full_name"), F.substring("n_name", 1, 3).alias("abbreviation")], F.lit(False), f"{base}/teams")
    teams, lost = L.read_teams(spark, f"{base}/teams")
    for rows, name in ((bad, "players"), (wrong, "info"), (lost, "teams")):
        L.store_bad(rows, f"{base}/bad", name)
    counts = [rows.agg(F.lit(name).alias("source"), F.count(F.lit(1)).alias("good")) for rows, name in ((good, "players"), (info, "info"), (teams, "teams"))]
    stored = spark.read.schema("file string, record string, source string").parquet(f"{base}/bad").groupBy(F.col("source").alias("__s")).agg(F.count("record").alias("bad"))
    both = counts[0].unionByName(counts[1]).unionByName(counts[2])
    return both.join(stored, F.col("source") == F.col("__s"), "left").select("source", "good", F.coalesce("bad", F.lit(0).cast("long")).alias("bad"))


@register("landing_info", "A3", """
select c_custkey as person_id, c_name as name, cast(c_nationkey as bigint) as team_id from customer
where c_custkey in (select o_custkey from orders where o_orderstatus = 'P')
""")
def landing_info(spark, sf_dir):
    """Player info of a table of players: customers with a pending order, from csv."""
    c, path = read_table(spark, sf_dir, "customer"), f"{_folder(spark)}/info"
    c.select(F.col("c_custkey").alias("PERSON_ID"), F.col("c_name").alias("DISPLAY_FIRST_LAST"), F.col("c_mktsegment").alias("POSITION"),
             F.lit(None).cast("string").alias("HEIGHT"), F.col("c_nationkey").alias("TEAM_ID")).write.option("header", True).csv(path)
    wanted = read_table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"))
    info, _ = L.read_player_info(spark, path, wanted, "csv")
    return info.select(F.col("PERSON_ID").alias("person_id"), F.col("DISPLAY_FIRST_LAST").alias("name"), F.col("TEAM_ID").alias("team_id"))
