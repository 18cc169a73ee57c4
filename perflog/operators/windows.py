"""Ordered per-entity window operators.

Most functions return a ``Column`` so callers can add many features in one
``withColumns``: Catalyst then groups window expressions that share a
partition/order spec into one ``WindowExec`` behind one exchange and one sort.
With ``per_season`` and the spec of :mod:`perflog.operators.split` they run in
pieces of bounded size, whatever an entity's share of the rows.  Operators that
need several passes (streaks, EWM, entity statistics) are ``DataFrame ->
DataFrame`` transforms.

Null semantics follow pandas ``rolling(n)`` (``min_periods = n``): any null in
the frame, or a frame shorter than ``n``, gives null.  Expanding means skip
nulls.  ``stddev`` is the sample (ddof = 1) form.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perflog.operators.split import CHUNK_SECONDS, bucketed, numbered
from perflog.operators.stats import with_entity_stats
from perflog.spec import LogSpec


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- D1 / D2 / D15
def rolling_mean(x, n: int, spec: LogSpec, per_season: bool = False) -> Column:
    """Mean of the current row and the n-1 before it; null until n non-null values."""
    w = spec.last_n(n, per_season)
    return F.when(F.count(_c(x)).over(w) == n, F.avg(_c(x)).over(w))


def last_values(x: str, n: int, spec: LogSpec, per_season: bool = False) -> dict[str, Column]:
    """Columns ``__l1`` to ``__l{n-1}``: ``x`` (a struct of measures) of the rows before, for :func:`sum_of_last`."""
    return {f"__l{k}": F.lag(_c(x), k).over(spec.w(per_season)) for k in range(1, n)}


def sum_of_last(x: str, field: str, n: int) -> Column:
    """:func:`rolling_sum` (a double) of a field of ``x`` from the columns of :func:`last_values`: one lag of the struct per row
    of the frame serves all fields and lengths, where a frame per field and length is summed anew for every row.  Added oldest
    first, as a frame is; null until there are n non-null values."""
    total = F.lit(0.0)
    for k in range(n - 1, -1, -1):
        total = total + F.col(f"__l{k}.{field}" if k else f"{x}.{field}")
    return total


def mean_of_last(x: str, field: str, n: int) -> Column:
    """:func:`rolling_mean` in the same way."""
    return sum_of_last(x, field, n) / F.lit(float(n))


def rolling_std(x, n: int, spec: LogSpec, per_season: bool = False) -> Column:
    w = spec.last_n(n, per_season)
    return F.when(F.count(_c(x)).over(w) == n, F.stddev_samp(_c(x)).over(w))


def rolling_sum(x, n: int, spec: LogSpec, per_season: bool = False) -> Column:
    w = spec.last_n(n, per_season)
    return F.when(F.count(_c(x)).over(w) == n, F.sum(_c(x)).over(w))


# ---------------------------------------------------------------- D3
def fill_from_entity(df: DataFrame, spec: LogSpec, means: dict[str, str] | None = None, stds: dict[str, str] | None = None,
                     per_season: bool = False) -> DataFrame:
    """Fill nulls (warm-up rows) of each named column with the entity's mean or sample
    standard deviation of another: ``{column: source}``."""
    means, stds = means or {}, stds or {}
    aggs = {f"__m_{x}": F.avg(x) for x in set(means.values())} | {f"__s_{x}": F.stddev_samp(x) for x in set(stds.values())}
    out = with_entity_stats(df, spec.keys(per_season), **aggs)
    filled = {c: F.coalesce(F.col(c), F.col(f"__m_{x}")) for c, x in means.items()} | {
        c: F.coalesce(F.col(c), F.col(f"__s_{x}")) for c, x in stds.items()}
    return out.withColumns(filled).drop(*aggs)


# ---------------------------------------------------------------- D4 EWM
def ewm_horizon(span: float, tol: float = 1e-17) -> int:
    """Rows after which an observation's weight q**k drops below ``tol``."""
    q = 1.0 - 2.0 / (span + 1.0)
    return int(math.ceil(math.log(tol) / math.log(q)))


def ewm(df: DataFrame, x: str, spans: dict[str, float], spec: LogSpec, chunk_seconds: int | None = None,
        keep: tuple[str, ...] = ()) -> DataFrame:
    """Exponentially weighted means, ``adjust=True``, alpha = 2/(span+1): ``{column: span}``.

    Linear in the rows: inside a bucket (and a halo as long as weights count in
    double precision) both sums are running sums of ``q**-position``; buckets are
    short enough for those powers.  A null adds to neither sum while older weights
    keep decaying, so it takes the value of the last non-null row, however far back.
    ``keep``: of ``__e`` and ``__rn`` (operators.split), those that stay for further windows in pieces.
    """
    spans = {c: max(1.0 + 1e-9, s) for c, s in spans.items()}
    back = max(ewm_horizon(s) for s in spans.values())
    size = min(int(600 / math.log((s + 1) / (s - 1))) for s in spans.values()) - back
    rows = numbered(df.withColumn("__none", F.col(x).isNull()), spec, "__none", chunk_seconds or CHUNK_SECONDS)
    # a null row belongs to the non-null row that its run of nulls follows, and is in that row's bucket
    rows = rows.withColumn("__head", F.when(F.col("__none"), F.col("__rn") - F.col("__run")).otherwise(F.col("__rn")))
    size = max(size, back)
    rows, inner = bucketed(rows, spec, back, size, "__head", ~F.col("__none"))
    upto = inner.running(True)
    # a halo holds the last ``back`` rows before the bucket
    place = F.col("__rn") - F.greatest(F.lit(0), F.col("__bucket") * size - back)
    last = F.max(F.when(~F.col("__none"), F.col("__rn"))).over(upto)
    cols = {}
    for c, s in spans.items():
        weight = F.pow(F.lit((s + 1) / (s - 1)), place)
        rows = rows.withColumn(f"__w_{c}", F.when(~F.col("__none"), weight))
        # on a null row as on the head of its run
        cols[c] = F.when(last == F.col("__head"), F.sum(F.col(x) * F.col(f"__w_{c}")).over(upto) / F.sum(f"__w_{c}").over(upto))
    rows = rows.withColumns(cols).where(~F.col("__halo"))
    return rows.drop("__none", "__head", "__run", "__bucket", "__halo", *[c for c in ("__e", "__rn") if c not in keep], *[f"__w_{c}" for c in spans])


def ewm_placed(rows: DataFrame, x: str, spans: dict[str, float], spec: LogSpec) -> tuple[DataFrame, LogSpec]:
    """:func:`ewm` on rows that are where operators.split.placed put them, for the rows where ``x`` is not null (null for others); no row moves.

    Sums run in blocks of ``__at``, and a row adds what the block before its own came to: of still older rows no weight is left.
    Returns the spec for further windows, too: its order is that of the blocks, so rows are sorted once for all."""
    spans = {c: max(1.0 + 1e-9, s) for c, s in spans.items()}
    size = max(max(ewm_horizon(s) for s in spans.values()), min(int(600 / math.log((s + 1) / (s - 1))) for s in spans.values()))
    there = F.col(x).isNotNull()
    rows = rows.withColumns({"__block": F.floor((F.col("__at") - 1) / size).cast("int"), "__place": ((F.col("__at") - 1) % size + 1).cast("int")})
    weights = {c: F.when(there, F.pow(F.lit((s + 1) / (s - 1)), F.col("__place"))) for c, s in spans.items()}
    rows = rows.withColumns({f"__w_{c}": w for c, w in weights.items()})
    upto = Window.partitionBy(*spec.keys(True), "__block").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"__{k}_{c}": F.coalesce(F.sum(F.col(x) * F.col(f"__w_{c}") if k == "s" else F.col(f"__w_{c}")).over(upto), F.lit(0.0))
                             for c in spans for k in "sn"})
    inner = spec.with_(time="__block", tie=("__at",))
    before = inner.rows(Window.unboundedPreceding, -1, True)
    rows = rows.withColumns({f"__b{k}_{c}": F.last(F.when(F.col("__place") == size, F.col(f"__{k}_{c}")), ignorenulls=True).over(before) for c in spans for k in "sn"})
    cols = {}
    for c, s in spans.items():
        old = ((s + 1) / (s - 1)) ** -size
        both = [F.col(f"__{k}_{c}") + F.coalesce(F.col(f"__b{k}_{c}"), F.lit(0.0)) * old for k in "sn"]
        cols[c] = F.when(there, both[0] / both[1])
    return rows.withColumns(cols).drop("__place", *[f"__{k}_{c}" for c in spans for k in ("w", "s", "n", "bs", "bn")]), inner


def ewm_fold(x, span: float, spec: LogSpec, per_season: bool = False) -> Column:
    """The same mean as a column: a fold over the last :func:`ewm_horizon` rows, null
    after as many nulls (:func:`carry_forward` holds the last value)."""
    q = 1.0 - 2.0 / (span + 1.0)
    frame = F.collect_list(F.struct(_c(x).cast("double").alias("v"))).over(spec.rows(-(ewm_horizon(span) - 1), 0, per_season))
    return F.aggregate(
        frame, F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("d")),
        lambda acc, e: F.struct((acc["n"] * q + F.coalesce(e["v"], F.lit(0.0))).alias("n"),
                                (acc["d"] * q + F.when(e["v"].isNotNull(), 1.0).otherwise(0.0)).alias("d")),
        lambda acc: F.when(acc["d"] > 0, acc["n"] / acc["d"]))


def carry_forward(df: DataFrame, cols: list[str], spec: LogSpec, per_season: bool = False) -> DataFrame:
    """Replace nulls by the last non-null value of the same entity (in time order)."""
    w = spec.running(per_season)
    return df.withColumns({c: F.coalesce(F.col(c), F.last(c, ignorenulls=True).over(w)) for c in cols})


# ---------------------------------------------------------------- D5 / D6 / D7
def expanding_mean(x, spec: LogSpec, per_season: bool = False) -> Column:
    return F.avg(_c(x)).over(spec.running(per_season))


def diff(x, spec: LogSpec, k: int = 1, per_season: bool = False) -> Column:
    return _c(x) - F.lag(_c(x), k).over(spec.w(per_season))


def trend(df: DataFrame, x: str, spec: LogSpec, n: int = 5, out: str | None = None,
          per_season: bool = False) -> DataFrame:
    """Rolling-n mean of first differences (the difference is materialised first)."""
    out = out or f"{x}_TREND"
    tmp = f"__{x}_diff"
    return (df.withColumn(tmp, diff(x, spec, 1, per_season))
              .withColumn(out, rolling_mean(tmp, n, spec, per_season))
              .drop(tmp))


# ---------------------------------------------------------------- D8 / D9 streaks
def streaks_of_run(result: str, run: str = "__run", win_value="W", loss_value="L") -> tuple[Column, Column]:
    """Win and loss streak from the length of the run of equal results (operators.split)."""
    r = F.col(result)
    return (F.when(r == F.lit(win_value), F.col(run)).otherwise(0).cast("int"),
            F.when(r == F.lit(loss_value), F.col(run)).otherwise(0).cast("int"))


def current_streaks(df: DataFrame, result: str, spec: LogSpec, win_value="W", loss_value="L",
                    win_out: str = "WIN_STREAK", loss_out: str = "LOSS_STREAK",
                    per_season: bool = False) -> DataFrame:
    """Length of the run of equal results ending at (and including) each row.

    Runs are islands of equal ``result`` (null equals null).  The streak is the
    row number minus the row number where the island started, plus one -- one
    exchange and one sort, no second partitioning by island.
    """
    w = spec.w(per_season)
    rn, start = "__rn", "__island_start"
    r = F.col(result)
    df = df.withColumns({
        rn: F.row_number().over(w),
        start: F.when(~F.lag(r).over(w).eqNullSafe(r) | F.lag(F.lit(1)).over(w).isNull(),
                      F.row_number().over(w)),
    })
    streak = F.col(rn) - F.max(start).over(spec.running(per_season)) + 1
    return (df.withColumns({
                win_out: F.when(r == F.lit(win_value), streak).otherwise(0).cast("int"),
                loss_out: F.when(r == F.lit(loss_value), streak).otherwise(0).cast("int")})
              .drop(rn, start))


def entering_streaks(df: DataFrame, win: str, spec: LogSpec, win_out: str = "CUM_WIN_STREAK",
                     loss_out: str = "CUM_LOSS_STREAK", per_season: bool = False) -> DataFrame:
    """Streak *entering* each row: wins (or non-wins) in a row just before it.

    Any value other than 1 counts as a loss, as in the reference loop.  The
    first row of an entity is 0/0.
    """
    flag = "__win_flag"
    df = df.withColumn(flag, F.coalesce((F.col(win) == 1).cast("int"), F.lit(0)))
    df = current_streaks(df, flag, spec, 1, 0, "__ws", "__ls", per_season)
    w = spec.w(per_season)
    return (df.withColumns({
                win_out: F.lag("__ws", 1, 0).over(w).cast("int"),
                loss_out: F.lag("__ls", 1, 0).over(w).cast("int")})
              .drop(flag, "__ws", "__ls"))


# ---------------------------------------------------------------- D10-D14
def prior_mean(x, n: int, spec: LogSpec, default=None, per_season: bool = False) -> Column:
    """Mean of the n rows before the current one (current excluded), else ``default``."""
    w = spec.prior_n(n, per_season)
    m = F.when(F.count(_c(x)).over(w) == n, F.avg(_c(x)).over(w))
    return m if default is None else F.coalesce(m, F.lit(default))


def momentum(df: DataFrame, x: str, spec: LogSpec, n: int = 3, out: str = "PM_TREND",
             threshold: float = 5.0, per_season: bool = False) -> DataFrame:
    """Change of the prior rolling-n mean from one row to the next, 0 when unknown,
    plus positive / negative momentum flags beyond +-threshold."""
    tmp = "__prior_mean"
    df = df.withColumn(tmp, prior_mean(x, n, spec, None, per_season))
    df = df.withColumn(out, momentum_of(tmp, spec, per_season))
    up, down = momentum_flags(out, threshold)
    return df.withColumns({"POSITIVE_MOMENTUM": up, "NEGATIVE_MOMENTUM": down}).drop(tmp)


def momentum_of(before: str, spec: LogSpec, per_season: bool = False) -> Column:
    """Change of a column of prior means from one row to the next, 0 when unknown."""
    return F.coalesce(F.col(before) - F.lag(before).over(spec.w(per_season)), F.lit(0.0))


def momentum_flags(trend_col: str, threshold: float = 5.0) -> tuple[Column, Column]:
    return (F.col(trend_col) > threshold).cast("int"), (F.col(trend_col) < -threshold).cast("int")


def lagged(x, k: int, spec: LogSpec, default=0, per_season: bool = False) -> Column:
    return F.lag(_c(x), k, default).over(spec.w(per_season))


# ---------------------------------------------------------------- D16 / D17
def days_rest(spec: LogSpec, first: int = 3, per_season: bool = False, time: str | None = None) -> Column:
    """Whole days since the entity's previous row; ``first`` for its first row.
    ``time`` names the time where ``spec`` orders by row number."""
    t = F.col(time or spec.time)
    prev = F.lag(t).over(spec.w(per_season))
    return F.coalesce(F.timestamp_diff("DAY", prev, t), F.lit(first)).cast("int")


def game_number(spec: LogSpec, per_season: bool = False) -> Column:
    return F.row_number().over(spec.w(per_season))


# ---------------------------------------------------------------- D19
def zscore(df: DataFrame, cols: list[str], spec: LogSpec, suffix: str = "_ZSCORE", per_season: bool = False) -> DataFrame:
    """(x - entity mean) / entity sample std; null when the std is zero or
    undefined, instead of dropping the column (fixed schema)."""
    aggs = {f"__m_{c}": F.avg(c) for c in cols} | {f"__s_{c}": F.stddev_samp(c) for c in cols}
    out = with_entity_stats(df, spec.keys(per_season), **aggs)
    return out.withColumns({c + suffix: F.when(F.col(f"__s_{c}") > 0, (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}"))
                            for c in cols}).drop(*aggs)
