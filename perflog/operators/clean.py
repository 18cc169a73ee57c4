"""Cleaning, gating and feature-set projection.

Statistics used for fills are per entity (the reference fills within one
entity's log) or, with ``by=None``, whole-frame scalars computed in one
partially aggregated pass.  Nothing here collects data to the driver.
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perflog.operators.ranges import PIECES, fill_along
from perflog.operators.split import numbered
from perflog.operators.stats import with_entity_stats
from perflog.spec import LogSpec

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


# ------------------------------------------------------------------ B1
def null_profile(df: DataFrame, cols: list[str] | None = None, label: str = "null_count") -> DataFrame:
    """One (column, count) row per column from a single aggregate pass."""
    cols = cols or df.columns
    wide = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols])
    return wide.unpivot([], [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in cols], "column", label)


def null_profile_change(before: DataFrame, after: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Before/after null counts side by side (both inputs are one-row-per-column tables)."""
    cols = cols or [c for c in before.columns if c in after.columns]
    b = null_profile(before, cols, "nulls_before")
    a = null_profile(after, cols, "nulls_after")
    return b.join(a, "column", "inner")


# ------------------------------------------------------------------ B2-B5
def fill_mean(df: DataFrame, cols: list[str], spec: LogSpec | None = None) -> DataFrame:
    """B2: fill with the column mean of the entity (or the whole frame); an
    all-null column stays null."""
    if spec is not None:
        out = with_entity_stats(df, spec.keys(), **{f"__m_{c}": F.avg(c) for c in cols})
        return out.withColumns({c: F.coalesce(F.col(c), F.col(f"__m_{c}")) for c in cols}).drop(*[f"__m_{c}" for c in cols])
    means = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(means[c]).cast("double")) for c in cols})


def fill_zero(df: DataFrame, cols: list[str]) -> DataFrame:
    """B3."""
    return df.na.fill(0, subset=cols)


def fill_unknown(df: DataFrame, cols: list[str], token: str = "UNK") -> DataFrame:
    """Team / matchup / opponent strings."""
    return df.na.fill(token, subset=cols)


def fill_mode(df: DataFrame, cols: list[str], by: list[str] | None = None,
              default: str = "Unknown") -> DataFrame:
    """Fill strings with the most frequent value of the group (ties -> the
    smallest value); all-null groups get ``default``.

    Values are counted by (group, value) and the best is taken from the counts, so
    no buffer holds the distinct values of a group.
    """
    for c in cols:
        counts = df.where(F.col(c).isNotNull()).groupBy(*(by or []), F.col(c).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
        top = F.min_by("__v", F.struct((-F.col("__n")).alias("n"), F.col("__v").alias("v"))).alias("__mode")
        if by:
            m = counts.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(by)]).agg(top)
            on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(by)]
            df = df.join(m, reduce(lambda a, b: a & b, on), "left").drop(*[f"__k{i}" for i in range(len(by))])
        else:
            df = df.withColumn("__mode", F.lit(counts.agg(top).first()[0]).cast(df.schema[c].dataType))
        df = df.withColumn(c, F.coalesce(F.col(c), F.col("__mode"), F.lit(default))).drop("__mode")
    return df


# ------------------------------------------------------------------ B6
def ffill_bfill(df: DataFrame, cols: list[str], by: list[str], order: list[str],
                as_of: _dt.date | None = None, pieces: int = PIECES) -> DataFrame:
    """Forward then backward fill in ingest order; a group with no value at all
    takes ``as_of`` (explicit, not the wall clock).  Groups are cut into ranges of ``order``, whose
    first column is a number, date or time, and values are carried over the cuts both ways."""
    out = fill_along(df, cols, by, order, pieces)
    return out if as_of is None else out.withColumns({c: F.coalesce(F.col(c), F.lit(as_of).cast(df.schema[c].dataType)) for c in cols})


# ------------------------------------------------------------------ B11-B13
def drop_incomplete(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop rows with a null feature or target."""
    return df.na.drop(subset=cols)


def min_rows_gate(df: DataFrame, spec: LogSpec, n: int, per_season: bool = False) -> DataFrame:
    """Keep only entities with at least n rows."""
    return with_entity_stats(df, spec.keys(per_season), __n=F.count(F.lit(1))).filter(F.col("__n") >= n).drop("__n")


def warmup_trim(df: DataFrame, spec: LogSpec, min_rows: int = 10, frac: float = 0.1,
                per_season: bool = False) -> DataFrame:
    """Drop each entity's first ``max(min_rows, floor(frac * n))`` rows.  A
    column ``__rn`` (operators.split) is used as the row number where there is one."""
    known = "__rn" in df.columns
    rows = df if known else (df.withColumn("__rn", F.row_number().over(spec.w(True))) if per_season else numbered(df, spec).drop("__e"))
    rows = with_entity_stats(rows, spec.keys(per_season), __n=F.count(F.lit(1)))
    return rows.filter(F.col("__rn") > F.greatest(F.lit(min_rows), F.floor(F.col("__n") * frac))).drop("__n", *([] if known else ["__rn"]))


# ------------------------------------------------------------------ B14-B16
def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    """Names of numeric (non-boolean) columns, minus any containing an
    excluded token."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC) and not any(p in f.name for p in exclude)]


def zscore_columns(df: DataFrame, exclude=("_ID", "DATE", "SEASON")) -> list[str]:
    """Columns the reference z-scores: numeric, not ID/date/season-named."""
    return numeric_columns(df, exclude)


def select_present(df: DataFrame, cols: list[str]) -> DataFrame:
    """Projection of those requested columns that exist."""
    return df.select(*[c for c in cols if c in df.columns])


def align_features(df: DataFrame, names: list[str], keep: list[str] | None = None) -> DataFrame:
    """Align rows to a model's feature names; missing features and nulls
    become 0.  Always by name, never by position."""
    cols: list[Column] = [F.col(k) for k in (keep or [])]
    for f in names:
        cols.append((F.coalesce(F.col(f).cast("double"), F.lit(0.0)) if f in df.columns
                     else F.lit(0.0)).alias(f))
    return df.select(*cols)
