"""Mutual information of features with a numeric target.

The target is cut into classes of equal frequency.  Two estimators follow:

* *binned*: the features are cut likewise, and the information is that of the table of counts;
* *nearest neighbours*: for each row the distance to the k-th nearest row of its class, along
  one feature, and the number of rows of any class within it; digamma terms of these
  counts are averaged (Ross' estimator for a class label and a continuous feature).

Both work on counts of distinct (feature, value, class), so repeated values weigh but do not
take room.  Sorted neighbours and counts of rows within a distance come from windows in
pieces (operators.ranges); no window holds a whole feature.  Counts and distances are read several times
and are checkpointed, so fitting runs jobs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perflog.operators.ranges import PIECES, running_total
from perflog.session import cut_lineage

#: Rows of a class that one window task holds when neighbours are looked up.
ROWS_PER_BUCKET = 100_000


def digamma(n: Column) -> Column:
    """Digamma of a positive number: six steps of the recurrence, then the asymptotic series."""
    x = n.cast("double")
    y = x + 6
    series = F.log(y) - 1 / (2 * y) - 1 / (12 * y ** 2) + 1 / (120 * y ** 4) - 1 / (252 * y ** 6)
    steps = F.lit(0.0)
    for i in range(6):
        steps = steps + 1 / (x + i)
    return series - steps


def frequency_classes(counts: DataFrame, by: list[str], value: str, n: str, bins: int, out: str, pieces: int = PIECES) -> DataFrame:
    """``counts`` (distinct values of each group with their number of rows) with the class of each value:
    ``bins`` times the share of rows below it, rounded down.  Equal values share a class."""
    rows = running_total(counts, by, [value], n, "__upto", pieces)
    total = counts.groupBy(*[F.col(c).alias(f"__t{i}") for i, c in enumerate(by)]).agg(F.sum(n).alias("__total"))
    if by:
        on = F.lit(True)
        for i, c in enumerate(by):
            on = on & F.col(c).eqNullSafe(F.col(f"__t{i}"))
        rows = rows.join(F.broadcast(total), on)  # a row per group
    else:
        rows = rows.join(F.broadcast(total))
    share = F.floor(bins * (F.col("__upto") - F.col(n)) / F.col("__total"))
    return rows.withColumn(out, share.cast("int")).drop("__upto", "__total", *[f"__t{i}" for i in range(len(by))])


def target_classes(df: DataFrame, target: str, bins: int = 10, pieces: int = PIECES) -> DataFrame:
    """(__y, label): the class of every distinct value of a numeric target."""
    counts = df.where(F.col(target).isNotNull()).groupBy(F.col(target).cast("double").alias("__y")).agg(F.count(F.lit(1)).alias("__n"))
    return frequency_classes(counts, [], "__y", "__n", bins, "label", pieces).select("__y", "label")


def labelled_counts(df: DataFrame, features: list[str], target: str, bins: int = 10, pieces: int = PIECES) -> DataFrame:
    """(feature, value, label, n): rows by distinct value and target class, checkpointed; rows without value or target don't count."""
    # a class is a range of the target, so it is told by the classes' least values: one row
    least = target_classes(df, target, bins, pieces).groupBy("label").agg(F.min("__y").alias("__from")).agg(
        F.array_sort(F.collect_list(F.struct("__from", "label"))).alias("__classes"))
    rows = df.where(F.col(target).isNotNull()).select(F.col(target).cast("double").alias("__y"), *[F.col(f).cast("double").alias(f) for f in features])
    below = F.filter("__classes", lambda c: c["__from"] <= F.col("__y"))
    rows = rows.join(F.broadcast(least)).withColumn("label", F.element_at(below, -1)["label"])
    long = rows.select("label", *features).unpivot(["label"], features, "feature", "value").where("value is not null")
    return cut_lineage(long.groupBy("feature", "value", "label").agg(F.count(F.lit(1)).alias("n")))


def binned_information(counts: DataFrame, bins: int = 10, pieces: int = PIECES) -> DataFrame:
    """(feature, mutual_info) with features cut into classes of equal frequency, from :func:`labelled_counts`."""
    values = counts.groupBy("feature", "value").agg(F.sum("n").alias("n"))
    classes = frequency_classes(values, ["feature"], "value", "n", bins, "xb", pieces).select("feature", "value", "xb")
    cell = counts.join(classes, ["feature", "value"]).groupBy("feature", "xb", "label").agg(F.sum("n").alias("nxy"))
    # a table of bins x classes for each feature
    cell = cell.withColumns({"n": F.sum("nxy").over(Window.partitionBy("feature")), "nx": F.sum("nxy").over(Window.partitionBy("feature", "xb")),
                             "ny": F.sum("nxy").over(Window.partitionBy("feature", "label"))})
    term = F.col("nxy") / F.col("n") * F.log(F.col("nxy") * F.col("n") / (F.col("nx") * F.col("ny")))
    return cell.groupBy("feature").agg(F.greatest(F.lit(0.0), F.sum(term)).alias("mutual_info"))


def neighbour_distances(counts: DataFrame, k: int, pieces: int = PIECES, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``counts`` of classes with two rows and more, with ``size`` (of the class), ``near`` (k, or one less than the class has)
    and ``distance`` to the ``near``-th nearest other row of the class."""
    size = counts.groupBy("feature", "label").agg(F.sum("n").alias("size"))
    rows = counts.join(F.broadcast(size), ["feature", "label"]).where("size > 1").withColumn("near", F.least(F.lit(k), F.col("size") - 1))
    rows = running_total(rows, ["feature", "label"], ["value"], F.lit(1), "__rn", pieces)
    # the k rows at both ends of a bucket are copied into the bucket next to it
    place, at = (F.col("__rn") - 1) % rows_per_bucket, F.floor((F.col("__rn") - 1) / rows_per_bucket)
    copies = F.array_compact(F.array(F.lit(0), F.when(place < k, F.lit(-1)), F.when(place >= rows_per_bucket - k, F.lit(1))))
    rows = rows.withColumn("__copy", F.explode(copies)).withColumn("__bucket", at + F.col("__copy"))
    w = Window.partitionBy("feature", "label", "__bucket").orderBy("__rn")
    near = [F.struct(F.lit(0.0).alias("d"), (F.col("n") - 1).alias("c"))]
    for j in range(1, k + 1):
        for f in (F.lag, F.lead):
            near.append(F.struct(F.abs(f("value", j).over(w) - F.col("value")).alias("d"), f("n", j).over(w).alias("c")))
    rows = rows.withColumn("__near", F.array_sort(F.filter(F.array(*near), lambda x: x["d"].isNotNull())))
    enough = F.aggregate("__near", F.struct(F.lit(0).cast("long").alias("c"), F.lit(0.0).alias("d")),
                         lambda acc, x: F.when(acc["c"] >= F.col("near"), acc).otherwise(F.struct((acc["c"] + x["c"]).alias("c"), x["d"].alias("d"))))
    return rows.withColumn("distance", enough["d"]).where("__copy = 0").drop("__near", "__copy", "__bucket", "__rn")


def within_distance(rows: DataFrame, counts: DataFrame, pieces: int = PIECES) -> DataFrame:
    """``rows`` with ``m``: rows of any class nearer than ``distance``; at distance 0 the rows of the same value.

    A row's own numbers go with its upper end, so that its two counts meet in one exchange and nothing is joined back."""
    values = counts.groupBy(F.col("feature").alias("f"), F.col("value").alias("v")).agg(F.sum("n").alias("add"))
    x, d = F.col("value"), F.col("distance")
    kept = [c for c in rows.columns if c not in ("feature", "value", "label")]
    kinds = {c: t for c, t in rows.dtypes}

    def no(*names: str) -> list[Column]:
        return [F.lit(None).cast(kinds[c]).alias(c) for c in names]

    points = values.select("f", "v", F.lit(1).alias("ord"), "add", F.lit(0).alias("sign"), *no("value", "label", *kept))
    # rows below the upper end, less rows up to the lower end; both ends belong to the value itself at distance 0
    upper = rows.select(F.col("feature").alias("f"), (x + d).alias("v"), F.when(d > 0, 0).otherwise(2).alias("ord"), F.lit(0).alias("add"), F.lit(1).alias("sign"),
                        "value", "label", *kept)
    lower = rows.select(F.col("feature").alias("f"), (x - d).alias("v"), F.when(d > 0, 2).otherwise(0).alias("ord"), F.lit(0).alias("add"), F.lit(-1).alias("sign"),
                        "value", "label", *no(*kept))
    both = points.unionByName(upper).unionByName(lower)
    total = running_total(both, ["f"], ["v", "ord"], "add", "__upto", pieces, cuts_of=values)
    return total.where("sign <> 0").groupBy(F.col("f").alias("feature"), "value", "label").agg(
        F.sum(F.col("sign") * F.col("__upto")).alias("m"), *[F.max(c).alias(c) for c in kept])


def neighbour_information(counts: DataFrame, k: int = 3, pieces: int = PIECES, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """(feature, mutual_info) by ``k`` nearest neighbours, from :func:`labelled_counts`; classes of one row don't count.

    Where the k-th neighbour has the same value (repeated values), the numbers of equal rows in the class and
    in all take the place of ``k`` and of the rows within the distance."""
    rows = cut_lineage(neighbour_distances(counts, k, pieces, rows_per_bucket))
    used = rows.select("feature", "value", "label", "n")
    rows = within_distance(rows, used, pieces)
    own = F.when(F.col("distance") > 0, F.col("near")).otherwise(F.col("n"))
    # a distance below the value's precision is lost when it is added to it; the value's own rows are always within
    m = F.greatest("m", "n")
    term = F.col("n") * (digamma(own) - digamma(m) - digamma(F.col("size")))
    g = rows.groupBy("feature").agg(F.sum(term).alias("t"), F.sum("n").alias("total"))
    return g.select("feature", F.greatest(F.lit(0.0), F.col("t") / F.col("total") + digamma(F.col("total"))).alias("mutual_info"))
