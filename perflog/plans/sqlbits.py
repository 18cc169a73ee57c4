"""Shared output normalisation for queries and their oracle SQL.

Every float leaving a query goes through ``decimal(38,8)`` and is rounded
half-up to 4 places, in Spark and in the oracle alike: the decimal step absorbs
summation-order noise, and both engines round decimals the same way.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r4(c: Column | str, places: int = 4) -> Column:
    """The decimal rounding; in whole hundred-millionths, which costs a tenth, where the number is small and far enough from a
    tie that both give the same."""
    c = F.col(c) if isinstance(c, str) else c
    exact = F.round(c.cast("decimal(38,8)"), places).cast("double")
    scaled, step = F.abs(c.cast("double")) * 1e8, 10 ** (8 - places)
    near = F.abs(scaled - F.floor(scaled) - 0.5)
    units = F.floor((F.floor(scaled + 0.5) + step // 2) / step)  # below 2**53 by far: whole numbers stay exact
    return F.when((scaled < 1e13) & (near > 0.01), F.when(c < 0, -units).otherwise(units) / float(10 ** places)).otherwise(exact)


def R4(expr: str, places: int = 4) -> str:
    return f"cast(round(cast({expr} as decimal(38,8)), {places}) as double)"


# SQL window clauses of the three log bindings
W_ORD = "partition by o_custkey order by o_orderdate, o_orderkey"
W_EV = "partition by user_id order by ts, event_id"
W_LI = "partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber, l_partkey"

WL_SQL = "case o_orderstatus when 'F' then 'W' when 'O' then 'L' end"


def rows(w: str, lo: int | None, hi: int) -> str:
    lo_s = "unbounded preceding" if lo is None else (f"{-lo} preceding" if lo < 0 else
                                                     ("current row" if lo == 0 else f"{lo} following"))
    hi_s = "current row" if hi == 0 else (f"{-hi} preceding" if hi < 0 else f"{hi} following")
    return f"({w} rows between {lo_s} and {hi_s})"


def roll_avg(x: str, n: int, w: str) -> str:
    f = rows(w, -(n - 1), 0)
    return f"case when count({x}) over {f} = {n} then avg({x}) over {f} end"


def roll_std(x: str, n: int, w: str) -> str:
    f = rows(w, -(n - 1), 0)
    return f"case when count({x}) over {f} = {n} then stddev_samp({x}) over {f} end"


def roll_sum(x: str, n: int, w: str) -> str:
    f = rows(w, -(n - 1), 0)
    return f"case when count({x}) over {f} = {n} then sum({x}) over {f} end"


def prior_avg(x: str, n: int, w: str) -> str:
    f = rows(w, -n, -1)
    return f"case when count({x}) over {f} = {n} then avg({x}) over {f} end"
