"""Rest, calendar and season-label expressions.

Wall-clock functions always take an explicit ``as_of`` so results are
reproducible.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ------------------------------------------------------------------ C16
def rest_flags(days, b2b_max: int = 1) -> dict[str, Column]:
    """Rest buckets 0 / (0,1] / (1,3] / >3 and back-to-back (<= b2b_max days;
    the team path uses < 2, i.e. ``b2b_max=1`` on whole days as well)."""
    d = _c(days)
    return {
        "no_rest": (d == 0).cast("int"),
        "short_rest": ((d > 0) & (d <= 1)).cast("int"),
        "normal_rest": ((d > 1) & (d <= 3)).cast("int"),
        "extended_rest": (d > 3).cast("int"),
        "back_to_back": (d <= b2b_max).cast("int"),
        "rest_bucket": (F.when(d == 0, "none").when(d <= 1, "short").when(d <= 3, "normal")
                         .otherwise("extended")),
    }


# ------------------------------------------------------------------ C17
def season_phase(t, rule: str = "disjoint") -> dict[str, Column]:
    """Month and season phase flags.

    ``disjoint`` (default): early = Oct-Dec, mid = Jan-Mar, late = Apr-Jun.
    ``service_literal``: the overlapping rule of the ingest path, kept on request
    (early is always 1, playoffs = month >= 5).
    """
    m = F.month(_c(t))
    if rule == "disjoint":
        return {"month": m, "early_season": m.isin(10, 11, 12).cast("int"),
                "mid_season": m.isin(1, 2, 3).cast("int"), "late_season": m.isin(4, 5, 6).cast("int")}
    if rule == "service_literal":
        return {"month": m, "early_season": ((m >= 10) | (m <= 11)).cast("int"),
                "mid_season": ((m >= 12) | (m <= 2)).cast("int"),
                "late_season": ((m >= 3) & (m <= 4)).cast("int"), "playoffs": (m >= 5).cast("int")}
    raise ValueError(rule)


# ------------------------------------------------------------------ C18
def _label(start_year: Column) -> Column:
    """``2023`` -> ``2023-24``."""
    return F.concat(start_year.cast("string"), F.lit("-"),
                    F.lpad(F.pmod(start_year + 1, F.lit(100)).cast("string"), 2, "0"))


def season_label_from_id(season_id, rule: str = "fixed") -> Column:
    """Season label from a season id such as ``22023`` or ``2023``.

    ``fixed`` (default): a 5-digit id carries the year in its last 4 digits.
    ``reference``: the first 4 characters are the year, whatever the length.
    Ids shorter than 4 characters give ``Unknown``.
    """
    s = _c(season_id).cast("string")
    if rule == "fixed":
        year = F.when(F.length(s) == 5, F.substring(s, 2, 4)).otherwise(F.substring(s, 1, 4))
    elif rule == "reference":
        year = F.substring(s, 1, 4)
    else:
        raise ValueError(rule)
    y = year.try_cast("int")
    return F.when((F.length(s) >= 4) & y.isNotNull(), _label(y)).otherwise(F.lit("Unknown"))


def season_label_from_date(t, rule: str = "fixed", cutover_month: int = 10) -> Column:
    """``fixed``: the season starts in ``cutover_month``.  ``reference``: month >= 7
    gives ``(y-1)-y``, else ``(y-2)-(y-1)`` (one season early, kept on request)."""
    d = _c(t)
    y, m = F.year(d), F.month(d)
    if rule == "fixed":
        return _label(F.when(m >= cutover_month, y).otherwise(y - 1))
    if rule == "reference":
        return _label(F.when(m >= 7, y - 1).otherwise(y - 2))
    raise ValueError(rule)


def season_label(season_id=None, season=None, date=None, rule: str = "fixed") -> Column:
    """From ``SEASON_ID`` if present, else ``SEASON``, else the date."""
    if season_id is not None:
        return season_label_from_id(season_id, rule)
    if season is not None:
        return _c(season).cast("string")
    if date is not None:
        return season_label_from_date(date, rule)
    raise ValueError("no season information")


# ------------------------------------------------------------------ C19 / C20
def current_season(as_of: _dt.date, variant: str = "label") -> str | int:
    """C19, two variants: ``label`` -- ``2024-25`` with an October cut-over;
    ``year`` -- the starting year with a July cut-over."""
    if variant == "label":
        y = as_of.year if as_of.month >= 10 else as_of.year - 1
        return f"{y}-{str(y + 1)[2:]}"
    if variant == "year":
        return as_of.year if as_of.month >= 7 else as_of.year - 1
    raise ValueError(variant)


def season_list(label, n) -> Column:
    """C20: the n season labels ending at ``label`` (oldest first), as an array."""
    start = F.substring(_c(label), 1, 4).cast("int")
    years = F.sequence(start - (F.lit(n) if isinstance(n, int) else _c(n)) + 1, start)
    return F.transform(years, _label)
