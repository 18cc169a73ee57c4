"""Evaluation, comparison and blending queries
over three naive per-entity predictors, all SQL-checkable; MLlib queries
(rows-only checks) live in :mod:`perflog.plans.q_ml`."""

from __future__ import annotations

from pyspark.sql import functions as F

from perflog.operators import metrics as M
from perflog.operators import windows as Wn
from perflog.operators.aggregates import metric_pivot as pivot_op
from perflog.operators.aggregates import unpivot_metrics
from perflog.operators.split import in_pieces
from perflog.plans.bindings import BOX, BOX_SQL, box_scores
from perflog.plans.registry import register
from perflog.plans.sqlbits import R4, W_LI, prior_avg, r4

MODELS = ("lag1", "mean3", "mean10")
_PRED_SQL = f"""
with b as ({BOX_SQL}),
p as (select l_suppkey, l_orderkey, l_linenumber, l_partkey, PTS as y,
        lag(PTS) over ({W_LI}) as lag1,
        {prior_avg('PTS', 3, W_LI)} as mean3,
        {prior_avg('PTS', 10, W_LI)} as mean10 from b),
long as ({' union all '.join(f"select l_suppkey, l_orderkey, l_linenumber, l_partkey, y, '{m}' as model, {m} as p from p"
                             for m in MODELS)})"""


def _wide_predictions(spark, sf_dir):
    b = box_scores(spark, sf_dir).select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", F.col("PTS").alias("y"))
    return in_pieces(b, BOX, 10, lambda p: {"lag1": Wn.lagged("y", 1, p, None, True), "mean3": Wn.prior_mean("y", 3, p, None, True),
                                            "mean10": Wn.prior_mean("y", 10, p, None, True)}).drop("l_shipdate")


def _long_predictions(spark, sf_dir):
    # Wide predictor columns -> long (model, p)
    return _wide_predictions(spark, sf_dir).unpivot(["l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "y"], list(MODELS), "model", "p")


def _reg_sql_cols() -> str:
    e = "(y - p)"
    return (f"{R4(f'avg(abs({e}))')} as mae, {R4(f'avg({e} * {e})')} as mse, "
            f"{R4(f'sqrt(avg({e} * {e}))')} as rmse, "
            f"{R4(f'case when var_pop(y) > 0 then 1 - sum({e} * {e}) / (count(*) * var_pop(y)) when sum({e} * {e}) = 0 then 1.0 else 0.0 end')} as r2, "
            "count(*) as n")


# ----------------------------------------------------------------- regression_metrics
@register("regression_metrics", "J1 J2 E9", f"""{_PRED_SQL}
select model, l_suppkey, {_reg_sql_cols()} from long where p is not null and y is not null
group by model, l_suppkey
""")
def regression_metrics(spark, sf_dir):
    m = M.regression_metrics(_long_predictions(spark, sf_dir), "y", "p", ["model", "l_suppkey"])
    return m.select("model", "l_suppkey", *[r4(c).alias(c) for c in ("mae", "mse", "rmse", "r2")], "n")


# ----------------------------------------------------------------- classification_metrics
_CLS_SQL = f"""
with b as ({BOX_SQL}),
w as (select *, cast(WL = 'W' as int) as win from b),
c as (select l_suppkey, win as y,
        case when coalesce({prior_avg('win', 5, W_LI)}, 0.5) >= 0.5 then 1 else 0 end as p from w),
cm as (select l_suppkey, y, p, count(*) as n from c group by all),
cls as (select l_suppkey, cc, sum(t) as t, sum(tp) as tp, sum(pr) as pr from (
          select l_suppkey, y as cc, n as t, case when y = p then n else 0 end as tp, 0 as pr from cm
          union all select l_suppkey, p as cc, 0, 0, n from cm) group by all),
pc as (select l_suppkey, t, tp, case when pr > 0 then tp / pr else 0.0 end as prec,
              case when t > 0 then tp / t else 0.0 end as rec from cls)
select l_suppkey, {R4('sum(tp) / sum(t)')} as accuracy, {R4('sum(t * prec) / sum(t)')} as precision,
  {R4('sum(t * rec) / sum(t)')} as recall,
  {R4('sum(t * case when prec + rec > 0 then 2 * prec * rec / (prec + rec) else 0.0 end) / sum(t)')} as f1,
  cast(sum(t) as bigint) as n
from pc group by l_suppkey
"""


@register("classification_metrics", "J3 J4", _CLS_SQL)
def classification_metrics(spark, sf_dir):
    s = BOX
    b = box_scores(spark, sf_dir).select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", (F.col("WL") == "W").cast("int").alias("y"))
    b = in_pieces(b, s, 5, lambda q: {"p": (Wn.prior_mean("y", 5, q, 0.5, True) >= 0.5).cast("int")})
    m = M.classification_metrics(b, "y", "p", ["l_suppkey"])
    return m.select("l_suppkey", *[r4(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")],
                    F.col("n").cast("bigint").alias("n"))


# ----------------------------------------------------------------- metric_pivot
@register("metric_pivot", "E6 E9", f"""{_PRED_SQL}
select model, {_reg_sql_cols()} from long where p is not null and y is not null group by model
""")
def metric_pivot(spark, sf_dir):
    wide = M.regression_metrics(_long_predictions(spark, sf_dir), "y", "p", ["model"])
    long = unpivot_metrics(wide, ["model"], ["mae", "mse", "rmse", "r2", "n"])       # E9
    piv = pivot_op(long, ["mae", "mse", "rmse", "r2", "n"])                         # E6
    return piv.select("model", *[r4(c).alias(c) for c in ("mae", "mse", "rmse", "r2")],
                      F.col("n").cast("bigint").alias("n"))


# ----------------------------------------------------------------- best_model
@register("best_model", "I10", f"""{_PRED_SQL},
m as (select model, avg(abs(y - p)) as mae, sqrt(avg((y - p) * (y - p))) as rmse,
        1 - sum((y - p) * (y - p)) / (count(*) * var_pop(y)) as r2
      from long where p is not null group by model),
l as (select model, 'mae' as metric, -mae as s from m union all select model, 'rmse', -rmse from m
      union all select model, 'r2', r2 from m),
r as (select metric, model, s, row_number() over (partition by metric order by s desc, model) as k from l)
select metric, model as best_model, {R4('s')} as best_score from r where k = 1
""")
def best_model(spark, sf_dir):
    wide = M.regression_metrics(_long_predictions(spark, sf_dir), "y", "p", ["model"])
    long = unpivot_metrics(wide, ["model"], ["mae", "rmse", "r2"])
    best = M.best_model(long)
    return best.select("metric", "best_model", r4("best_score").alias("best_score"))


# ----------------------------------------------------------------- ensemble_blend
def _blend_sql() -> str:
    def weight(m):
        e = f"(y - {m}) * (y - {m})"
        return (f"greatest(0.01, coalesce(1 - sum({e}) / (count({m}) * var_pop(case when {m} is not null then y end)), 1.0)) as w_{m}")
    top = " + ".join(f"coalesce({m} * w_{m}, 0)" for m in MODELS)
    total = " + ".join(f"case when {m} is not null then w_{m} else 0 end" for m in MODELS)
    count = " + ".join(f"cast({m} is not null as bigint)" for m in MODELS)
    return f"""{_PRED_SQL},
w as (select {', '.join(map(weight, MODELS))} from p)
select l_orderkey, l_linenumber, l_partkey, {R4(f'({top}) / ({total})')} as blend, {count} as n_models
from p, w where {count} > 0
"""


@register("ensemble_blend", "I11", _blend_sql())
def ensemble_blend(spark, sf_dir):
    wide = _wide_predictions(spark, sf_dir)
    out = M.ensemble_blend(wide, list(MODELS), M.r2_weights(wide, "y", list(MODELS))).where("n_models > 0")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", r4("blend").alias("blend"), "n_models")
