"""Entity statistics as aggregates joined back.

A whole-entity window buffers all rows of an entity in one task; a ``groupBy`` is
combined on the map side, and in the join back a hot entity's rows can be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_entity_stats(df: DataFrame, keys: list[str], **stats: Column) -> DataFrame:
    """``df`` with one aggregate column of its entity per keyword; a null key is an entity too."""
    g = df.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(*[c.alias(n) for n, c in stats.items()])
    on = None
    for i, k in enumerate(keys):
        same = F.col(k).eqNullSafe(F.col(f"__k{i}"))
        on = same if on is None else on & same
    return df.join(g, on, "left").drop(*[f"__k{i}" for i in range(len(keys))])
