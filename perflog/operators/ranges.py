"""Running state over a sorted column, in bounded pieces.

A window over a whole table or a whole entity is one task.  Here the sorted
column is cut into ranges of about as many rows each (cut points come from one mergeable
sketch per group), a window runs inside each (group, range), and what a
range must know of the others is carried over the small table of ranges: prefix
sums, last value before, first value after.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges per group: what a window task holds falls with it, and the table of ranges grows.
PIECES = 64


def same(left: Sequence[str], right: Sequence[str]) -> Column:
    """Null-safe equality of several columns."""
    on = F.lit(True)
    for a, b in zip(left, right):
        on = on & F.col(a).eqNullSafe(F.col(b))
    return on


def with_ranges(df: DataFrame, value: str, by: Sequence[str] = (), pieces: int = PIECES, cuts_of: DataFrame | None = None) -> DataFrame:
    """``df`` with ``__range``: the number of cut points below ``value``, so equal values share a range
    and ranges are in the order of the values; a null value is before all.  ``cuts_of``: rows that the
    cut points are taken from (default ``df``)."""
    at = F.percentile_approx(value, [i / pieces for i in range(1, pieces)], 100 * pieces)
    cuts = (cuts_of if cuts_of is not None else df).groupBy(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(by)]).agg(at.alias("__cuts"))
    # at most ``pieces`` numbers per group; a join by group would send all its rows to one task
    if by:
        out = df.join(F.broadcast(cuts), same(by, [f"__g{i}" for i in range(len(by))]), "left")
    else:
        out = df.join(F.broadcast(cuts))
    # the number of cut points below the value by halving: a row is compared with six of 63, in compiled code
    out = out.withColumn("__below", F.lit(0))
    for bit in reversed(range(max(1, pieces - 1).bit_length())):
        probe = F.col("__below") + (1 << bit)
        out = out.withColumn("__below", F.when(F.get("__cuts", probe - 1) < F.col(value), probe).otherwise(F.col("__below")))
    return out.withColumn("__range", F.when(F.col(value).isNotNull(), F.col("__below")).otherwise(F.lit(-1))).drop(
        "__cuts", "__below", *[f"__g{i}" for i in range(len(by))])


def running_totals(df: DataFrame, by: Sequence[str], order: Sequence[str], weights: dict[str, Column],
                   pieces: int = PIECES, cuts_of: DataFrame | None = None, span: float | None = None) -> DataFrame:
    """``df`` with a column per entry of ``weights``: its sum over the rows of the group up to and with the row's own, sorted by
    ``order`` (numbers; the first of them is cut into ranges).  Rows equal in ``order`` should be one row.

    Groups are few where cut points are looked for: the table of ranges, ``pieces`` rows per group, is broadcast, so that rows
    move once.

    ``span``: ranges of this fixed width, which spare the pass that looks for cut points, where a group's rows of one
    span are known to fit a task."""
    keys, at = [*by, "__range"], list(weights)
    rows = (with_ranges(df, order[0], by, pieces, cuts_of) if span is None
            else df.withColumn("__range", F.floor(F.col(order[0]) / span))).withColumns({f"__w{i}": weights[o] for i, o in enumerate(at)})
    names = [f"__k{i}" for i in range(len(keys))]
    sums = rows.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)]).agg(*[F.sum(f"__w{i}").alias(f"__s{i}") for i in range(len(at))])
    across = Window.partitionBy(*names[:-1]) if by else Window.partitionBy(F.lit(0))
    lower = across.orderBy(names[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*names, *[F.coalesce(F.sum(f"__s{i}").over(lower), F.lit(0)).alias(f"__low{i}") for i in range(len(at))])
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"__in{i}": F.sum(f"__w{i}").over(inside) for i in range(len(at))}).join(F.broadcast(sums) if span is None else sums, same(keys, names))
    return rows.withColumns({o: F.col(f"__in{i}") + F.col(f"__low{i}") for i, o in enumerate(at)}).drop(
        "__range", *names, *[f"__{k}{i}" for i in range(len(at)) for k in ("w", "in", "low")])


def running_total(df: DataFrame, by: Sequence[str], order: Sequence[str], weight: str | Column, out: str = "__upto",
                  pieces: int = PIECES, cuts_of: DataFrame | None = None) -> DataFrame:
    """:func:`running_totals` of one weight."""
    return running_totals(df, by, order, {out: F.col(weight) if isinstance(weight, str) else weight}, pieces, cuts_of)


def as_number(df: DataFrame, col: str) -> Column:
    """A number that sorts as the column: microseconds on the zone-free clock for dates and times."""
    kind = df.schema[col].dataType.simpleString()
    if kind not in ("date", "timestamp", "timestamp_ntz"):
        return F.col(col)
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(col).cast("timestamp_ntz"))


def fill_along(df: DataFrame, cols: Sequence[str], by: Sequence[str], order: Sequence[str], pieces: int = PIECES) -> DataFrame:
    """Forward, then backward fill of ``cols`` in each group, sorted by ``order`` (the first column of
    which is a number, date or time).  A range carries its last value forwards and its first one backwards."""
    at = "__order"
    rows = with_ranges(df.withColumn(at, as_number(df, order[0])), at, (), pieces)
    keys = [*by, "__range"]
    names = [f"__k{i}" for i in range(len(keys))]
    place = F.struct(*order)
    ends = rows.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)]).agg(
        *[f(c, F.when(F.col(c).isNotNull(), place)).alias(f"__{k}{i}") for i, c in enumerate(cols) for k, f in (("a", F.min_by), ("z", F.max_by))])
    across = Window.partitionBy(*names[:-1]) if by else Window.partitionBy(F.lit(0))
    across = across.orderBy(names[-1])
    earlier, later = across.rowsBetween(Window.unboundedPreceding, -1), across.rowsBetween(1, Window.unboundedFollowing)
    ends = ends.select(*names, *[F.last(f"__z{i}", True).over(earlier).alias(f"__p{i}") for i in range(len(cols))],
                       *[F.first(f"__a{i}", True).over(later).alias(f"__n{i}") for i in range(len(cols))])
    forth = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"__f{i}": F.last(c, True).over(forth) for i, c in enumerate(cols)}
                            | {f"__b{i}": F.last(c, True).over(back) for i, c in enumerate(cols)})
    rows = rows.join(ends, same(keys, names))
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.col(f"__f{i}"), F.col(f"__p{i}"), F.col(f"__b{i}"), F.col(f"__n{i}"))
                             for i, c in enumerate(cols)})
    return rows.drop(at, "__range", *names, *[f"__{k}{i}" for i in range(len(cols)) for k in "fbpn"])
