"""Column roles for an "entity, time, measures, outcome" log.

Every operator in :mod:`perflog.operators` is written against a ``LogSpec``
instead of fixed column names, so the same code serves basketball game logs,
customer order logs, user event streams or supplier shipment logs.

Ordering is always ``(time, *tie)`` -- a sort on time alone is not stable when
two rows share a timestamp, so a tie key is mandatory for reproducible windows.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LogSpec:
    entity: str                       # partition key (player, team, customer, user ...)
    time: str                         # event time (timestamp, timestamp_ntz or date)
    tie: tuple[str, ...] = ()         # total-order tie break within one time value
    season: str | None = None         # optional second partition level
    outcome: str | None = None        # 'W'/'L' style result column, if any
    measures: tuple[str, ...] = field(default_factory=tuple)

    # ---- keys -------------------------------------------------------------
    def keys(self, per_season: bool = False) -> list[str]:
        if per_season:
            if not self.season:
                raise ValueError("LogSpec has no season column")
            return [self.entity, self.season]
        return [self.entity]

    def order(self) -> list[Column]:
        # pandas sorts missing times last; do the same so both agree
        return [F.col(self.time).asc_nulls_last()] + [F.col(t).asc_nulls_last() for t in self.tie]

    def order_desc(self) -> list[Column]:
        return [F.col(self.time).desc_nulls_first()] + [F.col(t).desc_nulls_first() for t in self.tie]

    # ---- windows ----------------------------------------------------------
    def w(self, per_season: bool = False) -> WindowSpec:
        """Ordered entity window ``W`` (default frame for lag / row_number)."""
        return Window.partitionBy(*self.keys(per_season)).orderBy(*self.order())

    def rows(self, lo: int, hi: int, per_season: bool = False) -> WindowSpec:
        """``W.rowsBetween(lo, hi)``; use ``Window.unboundedPreceding`` for running frames."""
        return self.w(per_season).rowsBetween(lo, hi)

    def last_n(self, n: int, per_season: bool = False) -> WindowSpec:
        """``Wn``: the current row and the n-1 rows before it."""
        return self.rows(-(n - 1), 0, per_season)

    def prior_n(self, n: int, per_season: bool = False) -> WindowSpec:
        """``Wpn``: the n rows before the current one, excluding it."""
        return self.rows(-n, -1, per_season)

    def running(self, per_season: bool = False) -> WindowSpec:
        return self.rows(Window.unboundedPreceding, 0, per_season)

    def whole(self, per_season: bool = False) -> WindowSpec:
        """``We``: unordered entity window (entity-level statistics)."""
        return Window.partitionBy(*self.keys(per_season))

    def with_(self, **kw) -> "LogSpec":
        return replace(self, **kw)
