"""Season-level lag features.

Season tables hold one row per (entity, season): small per entity, so their
windows are cheap; they still partition by entity, never globally.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _prev_cols(stats: list[str], target: str, lag_a: int, w) -> dict:
    cols = {f"PREV_SEASON_{s}": (F.lag(s, lag_a).over(w) if lag_a else F.col(s)) for s in stats}
    cols["PREV_SEASON_GAMES"] = F.lag("GAMES_PLAYED", lag_a).over(w) if lag_a else F.col("GAMES_PLAYED")
    a = F.lag(target, lag_a).over(w) if lag_a else F.col(target)
    b = F.lag(target, lag_a + 1).over(w)
    return cols, a, b


def season_lag_features(seasons: DataFrame, entity: str, season: str, stats: list[str],
                        target: str) -> DataFrame:
    """D20 + D21 + F5 on a season-means table.

    For the i-th season of an entity (i = 0 for its first): ``PREV_SEASON_*``
    from season i-1, ``AGE`` = i + 20, ``EXPERIENCE`` = i, ``SEASON_TREND`` =
    s[i-1] - s[i-2] (0 when i = 1), ``PREV_<t>_2YR_AVG`` = mean of the one or
    two seasons before (a null propagates).  The first season has no history
    and is dropped; ``TARGET`` is the season's own value.
    """
    w = Window.partitionBy(entity).orderBy(season)
    i = F.row_number().over(w) - 1
    cols, a, b = _prev_cols(stats, target, 1, w)
    cols.update({
        "PREV_SEASON": F.lag(season, 1).over(w),
        "AGE": (i + 20).cast("int"), "EXPERIENCE": i.cast("int"),
        "SEASON_TREND": F.when(i >= 2, a - b).otherwise(F.lit(0.0)),
        f"PREV_{target}_2YR_AVG": F.when(i == 1, a).otherwise((a + b) / 2),
        "TARGET": F.col(target),
    })
    return seasons.withColumns(cols).filter(F.col("EXPERIENCE") >= 1)


def next_season_row(seasons: DataFrame, entity: str, season: str, stats: list[str],
                    target: str) -> DataFrame:
    """The scoring row for the season after each entity's latest one --
    the same features shifted one season forward (trend of the *target* stat)."""
    w = Window.partitionBy(entity).orderBy(season)
    n = F.count(F.lit(1)).over(Window.partitionBy(entity))
    i = F.row_number().over(w)
    cols, a, b = _prev_cols(stats, target, 0, w)
    cols.update({
        "PREV_SEASON": F.col(season),
        "AGE": (i + 20).cast("int"), "EXPERIENCE": i.cast("int"),
        "SEASON_TREND": F.when(i >= 2, a - b).otherwise(F.lit(0.0)),
        f"PREV_{target}_2YR_AVG": F.when(i == 1, a).otherwise((a + b) / 2),
        "__last": i == n,
    })
    return seasons.withColumns(cols).filter("__last").drop("__last")
