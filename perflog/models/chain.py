"""A fitted feature chain as a stored table.

One-hot encoding, selection by mutual information and standardising are fitted on
training rows only.  What was fitted is a small table with a version: the categories met, and
the chosen features in order with their mean and deviation.  Scoring joins that table:
no fitted object lives on the driver, and rows are aligned to it by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perflog.models import information as I
from perflog.session import cut_lineage
from perflog.sources.store import read_through

SCHEMA = "version string, position int, feature string, category string, chosen boolean, mutual_info double, mean double, std double"


def _one_hot_counts(df: DataFrame, category: str, prefix: str, target: str, classes: DataFrame) -> DataFrame:
    """(feature, category, value, label, n) of the one-hot of every category, from the counts of (category, class): no row is
    repeated for the categories that it doesn't have."""
    seen = df.groupBy(F.col(category).alias("category"), F.col(target).cast("double").alias("__y")).agg(F.count(F.lit(1)).alias("n"))
    seen = seen.join(classes, "__y").groupBy("category", "label").agg(F.sum("n").alias("n"))
    size = seen.groupBy("label").agg(F.sum("n").alias("size"))
    all_labels = size.agg(F.collect_list(F.struct("label", "size")).alias("__all"))  # one row of at most ``bins`` classes
    cats = seen.where("category is not null").groupBy("category").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("__has"))
    cells = cats.join(F.broadcast(all_labels)).select("category", "__has", F.explode("__all").alias("c"))
    ones = F.coalesce(F.try_element_at("__has", F.col("c.label")), F.lit(0))
    cells = cells.select("category", "c.label", F.explode(F.array(F.struct(F.lit(1.0).alias("value"), ones.alias("n")),
                                                                 F.struct(F.lit(0.0).alias("value"), (F.col("c.size") - ones).alias("n")))).alias("x"))
    return cells.select(F.concat(F.lit(prefix), F.col("category").cast("string")).alias("feature"), F.col("category").cast("string").alias("category"),
                        "x.value", "label", "x.n").where("n > 0")


def fit_chain(train: DataFrame, features: list[str], target: str, category: str | None = None, prefix: str = "OPP_", after: str | None = None,
              k: int = 20, bins: int = 10, neighbours: int = 3, version: str = "1") -> DataFrame:
    """The chain of some training rows: one row per feature (numeric ones by name, one-hots of ``category``).

    The ``k`` features of highest information with the target are chosen, in the order of ``features`` (one-hots
    in that of their names, behind the feature ``after``); all of them where there are no more than ten features or ten
    rows, as in the reference.  A deviation of 0 counts as 1.  ``train`` is read several times and should be stored or checkpointed."""
    if after is None:
        after = features[-1]
    counts = I.labelled_counts(train, features, target, bins)
    order = F.create_map(*[x for i, f in enumerate(features) for x in (F.lit(f), F.lit(i))])
    named = counts.select("feature", F.lit(None).cast("string").alias("category"), "value", "label", "n")
    if category is not None:
        # like the numeric features, one-hots count rows with a target
        hot = _one_hot_counts(train.where(F.col(target).isNotNull()), category, prefix, target, I.target_classes(train, target, bins))
        named = named.unionByName(cut_lineage(hot))  # both parts are stored
    info = I.neighbour_information(named.select("feature", "value", "label", "n"), neighbours)
    rows = F.sum("n")
    mean = F.sum(F.col("value") * F.col("n")) / rows
    # a row per feature: what the counts meet is broadcast
    center = named.groupBy("feature", "category").agg(mean.alias("mean"), rows.alias("rows"))
    spread = named.join(F.broadcast(center.select(F.col("feature").alias("f"), F.col("mean").alias("m"))), F.col("feature") == F.col("f")).groupBy("feature").agg(
        F.sqrt(F.sum(F.col("n") * (F.col("value") - F.col("m")) ** 2) / rows).alias("std"))
    table = center.join(spread, "feature").join(info, "feature", "left")
    at = F.when(F.col("category").isNull(), F.element_at(order, F.col("feature")).cast("double")).otherwise(features.index(after) + 0.5)
    # a table of one row per feature
    best = Window.orderBy(F.round(F.coalesce("mutual_info", F.lit(0.0)), 8).desc(), "__at", "feature")
    everything = Window.partitionBy(F.lit(0))
    table = table.withColumn("__at", at).withColumns({"__rank": F.row_number().over(best), "__all": F.count(F.lit(1)).over(everything),
                                                      "__rows": F.max("rows").over(everything)})
    chosen = (F.col("__rank") <= k) | (F.col("__all") <= 10) | (F.col("__rows") <= 10)
    return table.select(F.lit(version).alias("version"), F.row_number().over(Window.orderBy("__at", "feature")).alias("position"), "feature",
                        "category", chosen.alias("chosen"), "mutual_info", "mean", F.when(F.col("std") > 0, F.col("std")).otherwise(1.0).alias("std"))


def stored_chain(spark: SparkSession, path: str, version: str, fit, refresh: bool = False) -> DataFrame:
    """The chain of ``version`` in the table at ``path``; fitted by ``fit()`` and stored first where there is none."""
    return read_through(spark, f"{path}/version={version}", lambda: fit().drop("version").coalesce(1), refresh).withColumn("version", F.lit(version))


def _steps(chain: DataFrame) -> DataFrame:
    """One row: the chosen features in order (a bounded array)."""
    return chain.where("chosen").agg(F.array_sort(F.collect_list(F.struct("position", "feature", "category", "mean", "std"))).alias("__steps"))


def apply_chain(df: DataFrame, chain: DataFrame, features: list[str], category: str | None = None, out: str = "vector") -> DataFrame:
    """``df`` with ``out``: an array of the chain's features, scaled, in its order.  Features are found by name: one that ``df``
    lacks, or that is null, is 0 before scaling, and a category that the chain doesn't know leaves all its one-hots 0."""
    have = [f for f in features if f in df.columns]
    names = F.array(*[F.lit(f) for f in have])
    steps = _steps(chain).select(F.transform("__steps", lambda s: F.struct(
        s["category"].alias("category"), s["mean"].alias("mean"), s["std"].alias("std"), F.array_position(names, s["feature"]).cast("int").alias("at"))).alias("__steps"))
    values = F.array(*[F.col(f).cast("double") for f in have])
    cat = F.col(category).cast("string") if category is not None and category in df.columns else F.lit(None).cast("string")

    def value(s) -> Column:
        number = F.when(s["at"] > 0, F.try_element_at("__values", s["at"]))
        return F.coalesce(F.when(s["category"].isNull(), number).otherwise((cat == s["category"]).cast("double")), F.lit(0.0))

    out_df = df.withColumn("__values", values).join(F.broadcast(steps))
    return out_df.withColumn(out, F.transform("__steps", lambda s: (value(s) - s["mean"]) / s["std"])).drop("__values", "__steps")


def chain_features(chain: DataFrame) -> list[str]:
    """Names of the chosen features, in order (a handful of metadata)."""
    return [r.feature for r in chain.where("chosen").orderBy("position").select("feature").collect()]


def named_values(df: DataFrame, chain: DataFrame, keys: list[str], vector: str = "vector") -> DataFrame:
    """Long form (keys, feature, value) of the vectors of :func:`apply_chain`."""
    names = _steps(chain).select(F.transform("__steps", lambda s: s["feature"]).alias("__names"))
    long = df.select(*keys, vector).join(F.broadcast(names)).select(*keys, F.explode(F.arrays_zip(F.col("__names").alias("n"), F.col(vector).alias("v"))).alias("x"))
    return long.select(*keys, F.col("x.n").alias("feature"), F.col("x.v").alias("value"))
