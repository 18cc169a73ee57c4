"""Sort, top-k and set operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perflog.spec import LogSpec


def last_n(df: DataFrame, spec: LogSpec, n: int, rank_col: str = "recency_rank",
           per_season: bool = False) -> DataFrame:
    """Each entity's last n rows, newest first (rank 1 = newest); n <= 0 keeps all.

    ``row_number() <= n`` lets Catalyst insert a partial ``WindowGroupLimit``
    *before* the shuffle, so a hot entity sends at most n rows per map task.
    """
    w = Window.partitionBy(*spec.keys(per_season)).orderBy(*spec.order_desc())
    out = df.withColumn(rank_col, F.row_number().over(w))
    return out if n <= 0 else out.filter(F.col(rank_col) <= n)


def latest_per_entity(df: DataFrame, keys: list[str], order_col: str, offset: int = 0) -> DataFrame:
    """The latest (offset 0) or second-latest (offset 1) row per key."""
    w = Window.partitionBy(*keys).orderBy(F.col(order_col).desc_nulls_last())
    return (df.withColumn("__rk", F.row_number().over(w))
              .filter(F.col("__rk") == offset + 1).drop("__rk"))


def union_seasons(frames: list[DataFrame]) -> DataFrame:
    """H1: concatenate per-season frames whose schemas differ (missing -> null)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def dedup_latest(df: DataFrame, keys: list[str], version_col: str = "updated_at") -> DataFrame:
    """H2: keep the newest version of each key (latest wins, then the greatest row;
    rows without a key all stay).  Unlike ``dropDuplicates`` the survivor is
    chosen deterministically."""
    from perflog.sources.store import newest
    return newest(df, keys, [version_col])
