"""Stored tables: append, keyed upsert, delete, read-through.

The reference keeps one document collection per entity and season; here a
dataset is ONE parquet table (season as partition column, entity an ordinary
column).  Merges are lazy DataFrames; :func:`merge_stored` and :func:`delete_stored` write them back,
touched partitions alone.
"""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perflog.session import checkpoint_dir, cut_lineage


# ------------------------------------------------------------------ A8
def _ts_lit(t: _dt.datetime, typ="timestamp_ntz"):
    """A time literal built from text, so it does not depend on the Python
    process or session time zone."""
    return F.lit(t.isoformat(sep=" ")).cast(typ)


def stamp(df: DataFrame, as_of: _dt.datetime, col: str = "updated_at") -> DataFrame:
    return df.withColumn(col, _ts_lit(as_of))


# ------------------------------------------------------------------ A9
def _keyless(keys: list[str]) -> Column:
    out = F.lit(False)
    for k in keys:
        out = out | F.col(k).isNull()
    return out


def newest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the greatest by ``order`` (nulls lowest), then by all other
    columns, so the survivor never depends on row order.  Rows with a null key are
    all kept.  A map-side combined aggregate: a hot key ships one row per task."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.where(~_keyless(keys)).groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("__best"))
    out = best.select(*[F.col(c) if c in keys else F.col(f"__best.{c}").alias(c) for c in df.columns])
    return out.unionByName(df.where(_keyless(keys)))


def upsert_partial(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keyed partial upsert.

    * incoming rows whose key matches replace the columns the incoming batch
      *has* (nulls included); columns it lacks keep their stored values;
    * unmatched incoming rows are inserted (absent columns null);
    * rows with a null key, stored or incoming, are all kept as they are;
    * several incoming rows per key: the greatest by ``order`` wins (see :func:`newest`).

    One full outer join on the key; keyless rows go around it.
    """
    present = [c for c in incoming.columns if c not in keys]
    loose = [existing.where(_keyless(keys)), incoming.where(_keyless(keys))]
    inc = newest(incoming.where(~_keyless(keys)), keys, order)
    inc = inc.select(*keys, *[F.col(c).alias(f"__in_{c}") for c in present], F.lit(True).alias("__in"))
    j = existing.where(~_keyless(keys)).join(inc, keys, "full_outer")
    out = []
    for c in existing.columns:
        if c in present:
            out.append(F.when(F.col("__in").isNotNull(), F.col(f"__in_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    out += [F.col(f"__in_{c}").alias(c) for c in present if c not in existing.columns]
    done = j.select(*out)
    for extra in loose:
        done = done.unionByName(extra, allowMissingColumns=True)
    return done


def upsert_latest(existing: DataFrame, incoming: DataFrame, keys: list[str],
                  version_col: str = "updated_at") -> DataFrame:
    """Whole-record upsert: union, then the newest version of each key wins
    (the fix for append-only refreshes that duplicate rows); keyless rows stay."""
    return newest(existing.unionByName(incoming, allowMissingColumns=True), keys, [version_col])


# ------------------------------------------------------------------ A12
def delete_where(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows that survive a delete; a null predicate keeps the row."""
    return df.filter(~F.coalesce(predicate, F.lit(False)))


def count_where(df: DataFrame, predicate: Column) -> int:
    """The reference returns the number of deleted rows."""
    return df.filter(F.coalesce(predicate, F.lit(False))).count()


# ------------------------------------------------------------------ A9, A12 written back
def _in_partitions(df: DataFrame, touched: DataFrame, partition_by: list[str], how: str = "left_semi") -> DataFrame:
    t = touched.select(*[F.col(c).alias(f"__p{i}") for i, c in enumerate(partition_by)])
    on = F.lit(True)
    for i, c in enumerate(partition_by):
        on = on & F.col(c).eqNullSafe(F.col(f"__p{i}"))
    return df.join(t, on, how)


def _replace_partitions(spark: SparkSession, path: str, touched: DataFrame, rows: DataFrame, partition_by: list[str]) -> None:
    """Rewrite the ``touched`` partitions of the table at ``path`` so that they hold ``rows``; no other file is written.

    The rows are written beside the table first (into the shared folder), since they are read from it.  Partitions that
    end up empty are removed: the driver gets one folder name for each of these."""
    side = f"{checkpoint_dir(spark)}/merge-{uuid.uuid4().hex}"
    rows.write.partitionBy(*partition_by).parquet(side)
    stored = spark.read.schema(rows.schema).parquet(side)
    emptied = _in_partitions(touched, stored.select(*partition_by).distinct(), partition_by, "left_anti")
    folder = F.regexp_replace(F.input_file_name(), "/[^/]*$", "")
    gone = [r[0] for r in _in_partitions(spark.read.parquet(path).withColumn("__folder", folder), emptied, partition_by)
            .select("__folder").distinct().collect()]
    stored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)
    for name in gone:
        where = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def merge_stored(spark: SparkSession, path: str, incoming: DataFrame, keys: list[str], order: list[str], partition_by: list[str]) -> DataFrame:
    """Keyed partial upsert (:func:`upsert_partial`) into the stored table at ``path``, partitioned by ``partition_by``.

    Touched are the partitions that hold a key of the batch and those that the batch names; only these are
    read whole, merged and rewritten, all others keep their files.  A row whose partition value
    changes moves.  Returns the table."""
    incoming = cut_lineage(incoming)
    existing = spark.read.parquet(path)
    ids = incoming.where(~_keyless(keys)).select(*keys).distinct()
    touched = existing.join(ids, keys, "left_semi").select(*partition_by)
    if all(c in incoming.columns for c in partition_by):
        touched = touched.union(incoming.select(*partition_by))
    else:  # inserted rows have no partition value
        new = incoming.join(existing.select(*keys), keys, "left_anti").limit(1)
        touched = touched.union(new.select(*[F.lit(None).cast(existing.schema[c].dataType).alias(c) for c in partition_by]))
    touched = cut_lineage(touched.distinct())
    merged = upsert_partial(_in_partitions(existing, touched, partition_by), incoming, keys, order)
    _replace_partitions(spark, path, touched, merged, partition_by)
    return spark.read.option("mergeSchema", "true").parquet(path)


def delete_stored(spark: SparkSession, path: str, predicate: Column, partition_by: list[str]) -> int:
    """Delete rows of the stored table at ``path``; rewrites only the partitions that hold one.  Returns the number of rows deleted."""
    existing = spark.read.parquet(path)
    hit = cut_lineage(existing.where(F.coalesce(predicate, F.lit(False))).groupBy(*partition_by).agg(F.count(F.lit(1)).alias("__n")))
    n = hit.agg(F.sum("__n")).first()[0] or 0
    if n:
        touched = hit.select(*partition_by)
        _replace_partitions(spark, path, touched, delete_where(_in_partitions(existing, touched, partition_by), predicate), partition_by)
    return n


# ------------------------------------------------------------------ A8, A13
def append(df: DataFrame, path: str, as_of: _dt.datetime, partition_by: list[str] | None = None) -> None:
    """Stamp the rows and append them to the stored table."""
    w = stamp(df, as_of).write.mode("append")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def read_through(spark: SparkSession, path: str, build, refresh: bool = False,
                 partition_by: list[str] | None = None) -> DataFrame:
    """The stored table at ``path``; built (by a DataFrame-returning callable) and
    written first if ``refresh`` is set or there is none."""
    if not refresh:
        try:
            return spark.read.parquet(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    w = build().write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return spark.read.parquet(path)


# ------------------------------------------------------------------ A6
def recent_window(df: DataFrame, time_col: str, days: int, as_of: _dt.datetime) -> DataFrame:
    """Rows with ``as_of - days <= time <= as_of``; literal bounds reach the
    parquet scan as pushed filters."""
    lo = as_of - _dt.timedelta(days=days)
    t, typ = F.col(time_col), df.schema[time_col].dataType
    return df.filter((t >= _ts_lit(lo, typ)) & (t <= _ts_lit(as_of, typ)))


def is_fresh(df: DataFrame, time_col: str, days: int, as_of: _dt.datetime) -> bool:
    """A stored copy is valid only if its newest row is inside the window."""
    mx = df.agg(F.max(time_col)).first()[0]
    return mx is not None and mx >= as_of - _dt.timedelta(days=days)
