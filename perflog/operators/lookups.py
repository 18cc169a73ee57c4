"""Dimension lookups and opponent strength.

No lookup runs a job of its own or hints a broadcast for a table of unknown
size: adaptive execution chooses by the bytes it has seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perflog.functions.predict import DEFAULT_ROLE, STAT_ROLES
from perflog.operators import windows as Wn
from perflog.operators.ranges import as_number, running_totals
from perflog.operators.split import CHUNK_SECONDS, in_pieces
from perflog.spec import LogSpec


def lookup_defaults(df: DataFrame, dim: DataFrame, left_on: str, right_on: str, values: dict[str, tuple[str, object]]) -> DataFrame:
    """Left join dimension values, a default on a miss or a null.
    ``values``: output column -> (dimension column, default).  Of several rows of one
    key the smallest (by the values in the order given) counts, so the join never
    multiplies rows and never depends on their order.  Catalyst broadcasts the
    dimension where run-time statistics show it small, and splits a skewed join
    where not."""
    cols = list(dict.fromkeys(c for c, _ in values.values()))
    d = (dim.where(F.col(right_on).isNotNull()).groupBy(F.col(right_on).alias("__k"))
            .agg(F.min(F.struct(*[F.col(c).alias(f"__v{i}") for i, c in enumerate(cols)])).alias("__v")))
    j = df.join(d, F.col(left_on) == F.col("__k"), "left")
    return j.withColumns({out: F.coalesce(F.col(f"__v.__v{cols.index(c)}"), F.lit(default))
                          for out, (c, default) in values.items()}).drop("__k", "__v")


def lookup_default(df: DataFrame, dim: DataFrame, left_on: str, right_on: str, value: str,
                   default, out: str | None = None) -> DataFrame:
    """F1 / F4 for a single value."""
    return lookup_defaults(df, dim, left_on, right_on, {out or value: (value, default)})


def resolve_ids(df: DataFrame, dim: DataFrame, name_col: str, dim_name: str, dim_id: str,
                out: str = "id") -> DataFrame:
    """name -> id (inner join; unknown names drop out, the smallest id of a name that several bear counts)."""
    d = dim.groupBy(F.col(dim_name).alias("__n")).agg(F.min(dim_id).alias(out))
    return df.join(d, F.col(name_col) == F.col("__n"), "inner").drop("__n")


def role_table(spark: SparkSession) -> DataFrame:
    """F6 as a tiny fixed table (6 rows)."""
    return spark.createDataFrame(STAT_ROLES, "__stat string, role string, emphasis string")


def with_role_context(df: DataFrame, stat_col: str) -> DataFrame:
    """(role, emphasis) per stat, default all_around / balanced."""
    j = df.join(F.broadcast(role_table(df.sparkSession)), F.col(stat_col) == F.col("__stat"), "left").drop("__stat")
    return j.withColumns({"role": F.coalesce(F.col("role"), F.lit(DEFAULT_ROLE[0])),
                          "emphasis": F.coalesce(F.col("emphasis"), F.lit(DEFAULT_ROLE[1]))})


# ------------------------------------------------------------------ F2 / D18
def opponent_prior_win_rate(df: DataFrame, spec: LogSpec, opponent: str, opp_won: Column,
                            out: str = "OPP_STRENGTH", default: float = 0.5, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """Opponent strength = the opponent's win rate in all games *before* the
    row's own instant (0.5 when it has none); games of one day are told apart by their time.

    Rows are first reduced to one per (opponent, instant) -- a partially
    aggregated ``groupBy`` -- and the record entering each instant is a running sum in spans of
    time (operators.ranges), joined back on (opponent, instant).  Rows without a time or an opponent take the default.
    """
    at = as_number(df, spec.time)
    known = df.where(F.col(opponent).isNotNull() & F.col(spec.time).isNotNull())
    games = known.groupBy(F.col(opponent).alias("__opp"), at.alias("__at")).agg(
        F.sum(F.coalesce(opp_won.cast("long"), F.lit(0))).alias("__w"), F.count(F.lit(1)).alias("__g"))
    record = running_totals(games, ["__opp"], ["__at"], {"__uw": F.col("__w"), "__ug": F.col("__g")}, span=chunk_seconds * 1e6)
    prior = record.select("__opp", "__at", (F.col("__uw") - F.col("__w")).alias("__pw"), (F.col("__ug") - F.col("__g")).alias("__pg"))
    j = df.join(prior, (F.col(opponent) == F.col("__opp")) & (at == F.col("__at")), "left")
    rate = F.when(F.col("__pg") > 0, F.col("__pw") / F.col("__pg"))
    return j.withColumn(out, F.coalesce(rate, F.lit(default))).drop("__opp", "__at", "__pw", "__pg")


def schedule_strength(df: DataFrame, spec: LogSpec, strength: str = "OPP_STRENGTH",
                      rest: str = "DAYS_REST", windows=(5, 10), default: float = 0.5) -> DataFrame:
    """Rolling mean of opponent strength (current row included), 0.5 until
    the window is full; rest advantage = rest - 2; extra rest = rest >= 3.  ``rest`` is made
    where the log lacks it.  One pass over the entity's pieces serves all."""
    def build(p):
        cols = {f"SOS_{n}": F.coalesce(Wn.rolling_mean(strength, n, p, True), F.lit(default)) for n in windows}
        return cols if rest in df.columns else cols | {rest: Wn.days_rest(p, 3, True, spec.time)}

    cols, out = {}, in_pieces(df, spec, max(windows), build)
    if rest in out.columns:
        cols.update({"REST_ADVANTAGE": F.col(rest) - 2,
                     "BACK_TO_BACK": (F.col(rest) <= 1).cast("int"),
                     "EXTRA_REST": (F.col(rest) >= 3).cast("int")})
    return out.withColumns(cols)
