"""Bindings of the log roles to the driver's tables.

The driver tables hold no game logs; the same operators run on them through
``LogSpec`` roles:

* orders log   -- entity ``o_custkey``, time ``o_orderdate``, tie ``o_orderkey``;
  result ``WL`` = 'W' for status F, 'L' for O, missing for P.
* events log   -- entity ``user_id``, time ``ts``, tie ``event_id``;
  win = purchase or signup.
* lineitem log -- entity ``l_suppkey``, time ``l_shipdate``,
  tie ``(l_orderkey, l_linenumber, l_partkey)`` (the first two alone repeat).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perflog.sources.tables import read_table
from perflog.spec import LogSpec

ORDERS = LogSpec(entity="o_custkey", time="o_orderdate", tie=("o_orderkey",),
                 season="season", outcome="WL", measures=("o_totalprice",))
EVENTS = LogSpec(entity="user_id", time="ts", tie=("event_id",), season="season",
                 measures=("value",))
LINEITEM = LogSpec(entity="l_suppkey", time="l_shipdate", tie=("l_orderkey", "l_linenumber", "l_partkey"),
                   season="season", measures=("l_quantity", "l_extendedprice", "l_discount", "l_tax"))


def wl_from_status(status: Column) -> Column:
    return F.when(status == "F", "W").when(status == "O", "L")


def orders_log(spark: SparkSession, sf_dir: str, cols: list[str] | None = None) -> DataFrame:
    """Orders as a result log: adds ``WL``, ``WIN`` (0/1) and ``season`` (order year)."""
    o = read_table(spark, sf_dir, "orders")
    o = o.withColumns({
        "WL": wl_from_status(F.col("o_orderstatus")),
        "season": F.year("o_orderdate"),
    }).withColumn("WIN", F.coalesce((F.col("WL") == "W").cast("int"), F.lit(0)))
    return o.select(*cols) if cols else o


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.withColumns({
        "WIN": F.col("event_type").isin("purchase", "signup").cast("int"),
        # the whole table spans one month, so a "season" is an ISO week
        "season": F.weekofyear("ts"),
    })


def lineitem_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    return li.withColumn("season", F.year("l_shipdate"))


# ---------------------------------------------------------------------------
# A synthetic box score derived from lineitem by a fixed rule, so the ratio,
# rating, season and training-set operators have game-log-shaped input that
# grows with the table.  Entity = supplier ("team"), opponent = "N<k>".
BOX = LINEITEM.with_(outcome="WL")

BOX_SQL = """
select *, l_quantity as PTS,
  cast(l_linenumber - 1 as double) as FGA,
  least(cast(l_linenumber - 1 as double), cast(floor(l_quantity / 10) as double)) as FGM,
  cast(floor((l_linenumber - 1) / 2) as double) as FG3A,
  cast(floor(least(cast(l_linenumber - 1 as double), cast(floor(l_quantity / 10) as double)) / 2) as double) as FG3M,
  round(l_tax * 100) as FTA,
  greatest(round(l_tax * 100) - (l_linenumber % 2), 0) as FTM,
  cast(cast(l_quantity as int) % 4 as double) as OREB,
  cast(cast(l_quantity as int) % 7 as double) as DREB,
  cast(cast(l_quantity as int) % 4 + cast(l_quantity as int) % 7 as double) as REB,
  cast(cast(l_quantity as int) % 5 as double) as AST,
  cast(l_linenumber % 3 as double) as TOV,
  cast(l_orderkey % 3 as double) as STL,
  cast(l_partkey % 2 as double) as BLK,
  cast(20 + cast(l_quantity as int) % 20 as double) as MIN,
  l_quantity - 25.5 as PLUS_MINUS,
  case when l_linestatus = 'F' then 'W' else 'L' end as WL,
  case when l_linestatus = 'O' and l_returnflag = 'N' then null
       else concat('S', cast(l_suppkey as varchar),
                   case l_returnflag when 'R' then ' @ ' when 'A' then ' vs. ' else ' at ' end,
                   'N', cast(l_partkey % 30 as varchar)) end as MATCHUP
from lineitem
"""


def box_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rule as ``BOX_SQL`` in DataFrame form."""
    li = lineitem_log(spark, sf_dir)
    q = F.col("l_quantity")
    ln = F.col("l_linenumber")
    qi = q.cast("int")
    fga = (ln - 1).cast("double")
    fgm = F.least(fga, F.floor(q / 10).cast("double"))
    fta = F.round(F.col("l_tax") * 100)
    sep = (F.when(F.col("l_returnflag") == "R", " @ ").when(F.col("l_returnflag") == "A", " vs. ")
            .otherwise(" at "))
    matchup = F.when((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N"),
                     F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string"), sep, F.lit("N"),
                 (F.col("l_partkey") % 30).cast("string")))
    return li.withColumns({
        "PTS": q, "FGA": fga, "FGM": fgm,
        "FG3A": F.floor((ln - 1) / 2).cast("double"), "FG3M": F.floor(fgm / 2).cast("double"),
        "FTA": fta, "FTM": F.greatest(fta - (ln % 2), F.lit(0.0)),
        "OREB": (qi % 4).cast("double"), "DREB": (qi % 7).cast("double"),
        "REB": (qi % 4 + qi % 7).cast("double"), "AST": (qi % 5).cast("double"),
        "TOV": (ln % 3).cast("double"), "STL": (F.col("l_orderkey") % 3).cast("double"),
        "BLK": (F.col("l_partkey") % 2).cast("double"), "MIN": F.lit(20.0) + qi % 20,
        "PLUS_MINUS": q - 25.5, "WL": F.when(F.col("l_linestatus") == "F", "W").otherwise("L"),
        "MATCHUP": matchup,
    })
