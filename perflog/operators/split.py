"""Ordered windows in bounded pieces, for every entity alike.

A plain ``Window.partitionBy(entity)`` sends all rows of an entity to one task.
Here the rows are numbered and cut by time and by row number instead:

1. a row belongs to the (entity, chunk) of its time, a chunk being a fixed span;
   rows without a time form the last chunk, as ``LogSpec.order`` has them last.
   Spans are counted on the zone-free clock;
2. rows are numbered inside their chunk, and a prefix sum over the chunks'
   counts (a map-side combined aggregate, one row per entity and chunk) makes
   that the exact row number ``__rn`` of the entity.  The same small table
   carries running state over chunk borders: where the run of equal results
   that is open at a chunk's end began;
3. rows are cut into buckets of ``rows_per_bucket`` consecutive numbers, and the
   last ``lookback`` rows of a bucket are copied into the next as a *halo*, so
   every frame that looks back at most ``lookback`` rows is exact inside a bucket;
4. the caller's window columns run per (entity, bucket), and the halo goes.

One lazy plan: two scans (counts and rows), no job while it is built, no
threshold and no second path.  A window task holds one chunk's or one bucket's
rows.  ``chunk_seconds`` must be chosen so that an entity's rows of one span fit a
task; rows of one instant cannot be parted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perflog.spec import LogSpec

Builder = Callable[[LogSpec], dict[str, Column]]
DAY = 86_400
#: Spans and buckets of the defaults: 30 days, 100 000 rows.
CHUNK_SECONDS, ROWS_PER_BUCKET = 30 * DAY, 100_000
_LAST = (1 << 62)


def chunk_of(spec: LogSpec, chunk_seconds: int, kind: str) -> Column:
    """Number of the time span; null times come last."""
    t = F.col(spec.time)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    seconds = F.unix_seconds(t) if kind == "timestamp" else F.timestamp_diff("SECOND", epoch, t.cast("timestamp_ntz"))
    return F.coalesce(F.floor(seconds / chunk_seconds), F.lit(_LAST)).cast("long")


def _entity(spec: LogSpec) -> Column:
    # a key that joins: null is an entity like any other
    return F.coalesce(F.concat(F.lit("="), F.col(spec.entity).cast("string")), F.lit(""))


def numbered(df: DataFrame, spec: LogSpec, result: str | None = None, chunk_seconds: int = CHUNK_SECONDS, total: bool = False,
             stats: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with ``__e`` (entity key), ``__rn`` (row number of the entity, from 1) and, for ``result``,
    ``__run`` (length so far of the run of equal results that the row is in; null equals null), for ``total``
    ``__total`` (rows of the entity), for ``stats`` these aggregates of the entity's rows.  They join the small table of chunks, which
    the rows meet anyway: no rows are dealt by entity for them."""
    keys = ["__e", "__chunk"]
    rows = df.withColumns({"__e": _entity(spec), "__chunk": chunk_of(spec, chunk_seconds, df.schema[spec.time].dataType.simpleString())})
    inside = Window.partitionBy(*keys).orderBy(*spec.order())
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("__e").orderBy("__chunk")
    lower = before.rowsBetween(Window.unboundedPreceding, -1)
    place = F.row_number().over(inside)
    more = [F.sum("__n").over(Window.partitionBy("__e")).alias("__total")] if total else []
    more += [F.col(c) for c in stats or {}]
    entity = rows.groupBy("__e").agg(*[c.alias(n) for n, c in stats.items()]) if stats else None
    if result is None:
        size = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
        size = size if entity is None else size.join(entity, "__e")
        offset = size.select(*keys, F.coalesce(F.sum("__n").over(lower), F.lit(0)).alias("__off"), *more)
        return rows.withColumn("__rn", place).join(offset, keys).withColumn("__rn", F.col("__rn") + F.col("__off")).drop("__off", "__chunk")
    r = F.col(result)
    # inside a chunk: a run begins where the result differs from the row before; the first row is not known yet
    rows = rows.withColumns({"__rn": place, "__first": F.first(r).over(upto),
                             "__turn": F.when(~F.lag(r).over(inside).eqNullSafe(r) & (place > 1), place)})
    size = rows.select(*keys, r.alias("__r"), "__rn", "__turn", "__first").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), F.max("__turn").alias("__turn_n"), F.max_by(F.struct("__r"), "__rn").alias("__z"),
        F.min_by(F.struct(F.col("__first").alias("__r")), "__rn").alias("__a"))
    size = size.withColumns({"__off": F.coalesce(F.sum("__n").over(lower), F.lit(0)), "__prev": F.lag("__z").over(before)})
    size = size if entity is None else size.join(entity, "__e")
    opens = F.col("__prev").isNull() | ~F.col("__prev").eqNullSafe(F.col("__a"))
    # where the run open at the chunk's end began, if it began in the chunk
    start = F.coalesce(F.col("__off") + F.col("__turn_n"), F.when(opens, F.col("__off") + 1))
    size = size.withColumns({"__start": start, "__opens": opens})
    size = size.select(*keys, "__off", F.when(F.col("__opens"), F.col("__off") + 1).otherwise(F.max("__start").over(lower)).alias("__carry"), *more)
    rows = rows.join(size, keys)
    begun = F.coalesce(F.col("__off") + F.max("__turn").over(upto), F.col("__carry"))
    rows = rows.withColumn("__run", F.col("__off") + F.col("__rn") - begun + 1)
    return rows.withColumn("__rn", F.col("__rn") + F.col("__off")).drop("__off", "__chunk", "__first", "__turn", "__carry")


def running_means(df: DataFrame, spec: LogSpec, cols: dict[str, str], chunk_seconds: int = CHUNK_SECONDS, whole: str | None = None) -> DataFrame:
    """``df`` with ``__e``, ``__rn`` and expanding means (nulls skipped, current row included): ``{column: source}``.
    A chunk's sums go on from the prefix sums of the chunks before it.  All sums are fields of one struct, so the
    join of rows and chunks stays as short to plan for dozens of columns as for one.

    ``whole``: adds ``__whole``, the entity's number of rows where this column and all means are not null, which the table of
    chunks tells: once a source was seen its mean is there for good, so of a chunk's rows those after the last first sight count.
    Chunks are summed up from the running sums of their rows, so rows move once."""
    keys, sources = ["__e", "__chunk"], list(dict.fromkeys(cols.values()))
    rows = df.withColumns({"__e": _entity(spec), "__chunk": chunk_of(spec, chunk_seconds, df.schema[spec.time].dataType.simpleString())})

    at = [(i, F.col(x)) for i, x in enumerate(sources)]

    inside = Window.partitionBy(*keys).orderBy(*spec.order())
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"__rn": F.row_number().over(inside), "__in": F.struct(
        *[F.coalesce(F.sum(x).over(upto), F.lit(0)).alias(f"s{i}") for i, x in at], *[F.count(x).over(upto).alias(f"c{i}") for i, x in at])})
    there = F.lit(True) if whole is None else F.col(whole).isNotNull()
    # the entity's own column is a key here, too, so that both uses of the rows read one exchange
    size = rows.groupBy(*keys, spec.entity).agg(
        F.max("__rn").alias("__n"), F.max_by("__in", "__rn").alias("__sums"), F.count(F.when(there, 1)).alias("__y"),
        F.struct(*[F.count(F.when(there & (F.col(f"__in.c{i}") > 0), 1)).alias(f"n{i}") for i, _ in at]).alias("__after"))
    before = Window.partitionBy("__e").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = size.select(*keys, "__y", "__after", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"),
                        F.struct(*[F.coalesce(F.sum(f"__sums.{k}{i}").over(before), F.lit(0)).alias(f"{k}{i}") for k in "sc" for i, _ in at]).alias("__low"))
    # a source not seen before the chunk leaves the rows from its first sight on
    left = F.least("__y", "__y", *[F.when(F.col(f"__low.c{i}") == 0, F.col(f"__after.n{i}")).otherwise(F.col("__y")) for i, _ in at])
    carry = carry.withColumn("__whole", F.sum(left).over(Window.partitionBy("__e"))).drop("__y", "__after")
    rows = rows.join(carry, keys)

    def both(x):
        return F.col(f"__in.{x}") + F.col(f"__low.{x}")

    means = {c: F.try_divide(both(f"s{sources.index(x)}"), both(f"c{sources.index(x)}")) for c, x in cols.items()}
    return rows.withColumns(means | {"__rn": F.col("__rn") + F.col("__off")}).drop(
        "__chunk", "__off", "__in", "__low", *(["__whole"] if whole is None else []))


def bucketed(rows: DataFrame, spec: LogSpec, lookback: int, rows_per_bucket: int = ROWS_PER_BUCKET, number: str = "__rn",
             halo: Column | None = None) -> tuple[DataFrame, LogSpec]:
    """Numbered rows with ``__bucket`` and ``__halo``, and the spec whose windows run inside a bucket.
    ``number``: the row number that names a row's own bucket; ``halo``: rows that others look back at (default all)."""
    if rows_per_bucket < max(1, lookback):
        raise ValueError("rows_per_bucket must be lookback or more")
    at = F.floor((F.col(number) - 1) / rows_per_bucket).cast("long")
    if lookback:
        tail = (F.col("__rn") - 1) % rows_per_bucket >= rows_per_bucket - lookback
        tail = tail if halo is None else tail & halo
        copies = F.when(tail, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        rows = rows.withColumn("__more", F.explode(copies))
        rows = rows.withColumns({"__bucket": at + F.col("__more"), "__halo": F.col("__more") == 1}).drop("__more")
    else:
        rows = rows.withColumns({"__bucket": at, "__halo": F.lit(False)})
    return rows, LogSpec(entity="__e", time="__rn", season="__bucket")


def per_bucket(stats: DataFrame, spec: LogSpec, count: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """A table of one row per entity, ``count`` its rows, with a row for every bucket (``__e``, ``__bucket``) of the entity: it joins
    bucketed rows where they are."""
    buckets = F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / rows_per_bucket).cast("long"))
    return stats.withColumns({"__e": _entity(spec), "__bucket": F.explode(buckets)})


def large_entities(df: DataFrame, spec: LogSpec, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """(__k, __n): entities of more than ``rows_per_bucket`` rows with their number; at most one for that many rows of the table."""
    return df.groupBy(F.col(spec.entity).alias("__k")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > rows_per_bucket)


def cuts_of(df: DataFrame, spec: LogSpec, large: DataFrame, lookback: int, chunk_seconds: int = CHUNK_SECONDS,
            rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Where the ``large`` entities are cut: a row per entity and chunk with the bucket that the chunk is in, the rows before it, the entity's rows,
    and the later buckets whose first rows look back at it.  Consecutive chunks make a bucket of about ``rows_per_bucket`` rows."""
    chunk = chunk_of(spec, chunk_seconds, df.schema[spec.time].dataType.simpleString())
    rows = df.select(F.col(spec.entity).alias("__of"), chunk.alias("__span")).join(F.broadcast(large), F.col("__of").eqNullSafe(F.col("__k")))
    size = rows.groupBy("__of", "__span").agg(F.count(F.lit(1)).alias("__s"), F.max("__n").alias("__all"))
    in_time = Window.partitionBy("__of").orderBy("__span")
    size = size.withColumn("__off", F.coalesce(F.sum("__s").over(in_time.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    size = size.withColumn("__own", F.floor(F.col("__off") / rows_per_bucket).cast("long"))
    size = size.withColumns({"__next": F.lead("__own").over(in_time), "__end": F.col("__off") + F.col("__s")})
    ahead = Window.partitionBy("__of").orderBy("__end").rangeBetween(0, max(0, lookback - 1))
    later = F.array_distinct(F.collect_list(F.when(F.col("__next") != F.col("__own"), F.col("__next"))).over(ahead))
    return size.withColumn("__later", later).drop("__s", "__next", "__end")


def placed(df: DataFrame, spec: LogSpec, cuts: DataFrame, chunk_seconds: int = CHUNK_SECONDS) -> tuple[DataFrame, LogSpec]:
    """``df`` with ``__bucket``, ``__halo``, ``__rn`` (row number of the entity) and ``__total`` (its rows), and the spec whose windows run inside a bucket;
    the entity's column is ``__e``.

    Rows move once, to (entity, bucket): an entity that isn't large is one bucket, and the place of the others' rows is told by the table of
    :func:`cuts_of`, which is broadcast.  Halos are whole chunks."""
    chunk = chunk_of(spec, chunk_seconds, df.schema[spec.time].dataType.simpleString())
    rows = df.withColumn("__chunk", chunk).join(F.broadcast(cuts), F.col(spec.entity).eqNullSafe(F.col("__of")) & (F.col("__chunk") == F.col("__span")), "left")
    rows = rows.withColumn("__own", F.coalesce("__own", F.lit(0).cast("long")))
    to = F.when(F.size("__later") > 0, F.concat(F.array("__own"), "__later")).otherwise(F.array("__own"))
    rows = rows.withColumn("__bucket", F.explode(to))
    rows = rows.withColumn("__halo", F.col("__bucket") != F.col("__own")).drop("__chunk", "__of", "__span", "__own", "__later")
    rows, inner = rows.withColumnRenamed(spec.entity, "__e"), spec.with_(entity="__e", season="__bucket")
    w = inner.w(True)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # chunks are whole, so a bucket's first row tells where it begins
    rows = rows.withColumns({"__at": F.row_number().over(w), "__low": F.first("__off").over(w.rowsBetween(Window.unboundedPreceding, 0)),
                             "__rows": F.count(F.lit(1)).over(whole)})
    rows = rows.withColumns({"__rn": F.coalesce("__low", F.lit(0)) + F.col("__at"), "__total": F.coalesce("__all", "__rows")})
    return rows.drop("__low", "__rows", "__off", "__all"), inner


def finish(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Without halo rows and helper columns (but those in ``keep``)."""
    return rows.where(~F.col("__halo")).drop(*[c for c in ("__e", "__bucket", "__halo", "__rn", "__run") if c not in keep])


def in_pieces(df: DataFrame, spec: LogSpec, lookback: int, *steps: Builder, result: str | None = None, keep: tuple[str, ...] = (),
              chunk_seconds: int = CHUNK_SECONDS, rows_per_bucket: int = ROWS_PER_BUCKET, total: bool = False) -> DataFrame:
    """``df`` with the window columns of ``steps``, computed piece by piece.

    Each step maps a spec to named columns and may use those of the steps before; windows come from the spec's
    ``per_season`` forms and look back at most ``lookback`` rows, all steps together.  ``__rn`` and, with ``result``, ``__run`` are
    there for the steps to use."""
    rows, inner = bucketed(numbered(df, spec, result, chunk_seconds, total), spec, lookback, rows_per_bucket)
    for step in steps:
        rows = rows.withColumns(step(inner))
    return finish(rows, keep)
