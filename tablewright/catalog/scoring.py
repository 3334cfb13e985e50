"""Metrics, drift, gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.catalog.registry import bucket_sql, query, rounded, table, using, view
from tablewright.operators import metrics as M
from tablewright.operators.split import holdout_split

# A linear score of the modelling view, so that metrics can be checked without a fitted model.
_WEIGHTS = {"n_lines": 3000.0, "sum_qty": 1200.0}
_SCORE = "n_lines * 3000.0 + sum_qty * 1200.0"
_SCORED = f"scored as (select *, {_SCORE} as prediction, revenue - ({_SCORE}) as e from fx_model)"
_METRICS = """select count(*) as n, round(sqrt(avg(e * e)), 6) as rmse, round(avg(abs(e)), 6) as mae,
    round(1 - avg(e * e) / var_pop(revenue), 6) as r2, round(stddev_samp(revenue), 6) as target_std,
    round(stddev_samp(prediction), 6) as prediction_std, round(avg(e), 6) as mean_residual,
    round(sqrt(avg(e * e)) / greatest(stddev_samp(revenue), 1e-8), 6) as relative_rmse from scored"""


def _scored(spark, sf_dir):
    score = sum(F.col(c) * F.lit(w) for c, w in _WEIGHTS.items())
    return view(spark, sf_dir, "fx_model").withColumn("prediction", score)


@query("regression_metrics", using("fx_model") + f", {_SCORED} {_METRICS}")
def regression(spark, sf_dir):
    return rounded(M.regression_metrics(_scored(spark, sf_dir), "revenue", "prediction"))


@query("confusion_matrix", using("fx_classes") + "select y as actual, pred as predicted, count(*) as n from fx_classes group by y, pred")
def confusion(spark, sf_dir):
    return M.confusion_matrix(view(spark, sf_dir, "fx_classes"), "y", "pred")


@query(
    "classification_metrics",
    using("fx_classes")
    + """, k as (select unnest([0, 1]) as c), f as (select c, 2.0 * count(*) filter (y = c and pred = c)
      / (count(*) filter (y = c) + count(*) filter (pred = c)) as f1 from fx_classes, k group by c)
    select count(*) as n, round(avg(cast(y = pred as int)), 6) as accuracy,
      round((select avg(f1) from f), 6) as f1_macro from fx_classes""",
)
def classification(spark, sf_dir):
    return rounded(M.classification_metrics(view(spark, sf_dir, "fx_classes"), "y", "pred"))


@query(
    "roc_auc",
    using("fx_classes")
    + """, r as (select y, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as r from fx_classes),
      s as (select count(*) filter (y = 1) as p, count(*) filter (y = 0) as q, sum(r) filter (y = 1) as t from r)
    select p as positives, q as negatives, round((t - p * (p + 1) / 2.0) / (p * q), 6) as roc_auc from s""",
)
def auc(spark, sf_dir):
    return rounded(M.roc_auc(view(spark, sf_dir, "fx_classes"), "y", "score"))


@query(
    "binary_f1",
    using("fx_classes")
    + """select round(2.0 * count(*) filter (y = 1 and pred = 1) / (count(*) filter (y = 1) + count(*) filter (pred = 1)), 6)
      as f1 from fx_classes""",
)
def f1(spark, sf_dir):
    return rounded(M.binary_f1(view(spark, sf_dir, "fx_classes"), "y", "pred"))


_SIDES = f""", sided as (select *, {bucket_sql('row_id', 'holdout')} % 10000 < 2000 as v from fx_model)"""


def _sides(spark, sf_dir):
    """Training rows, and test rows without one column and with another on top."""
    split = holdout_split(view(spark, sf_dir, "fx_model"), "row_id")
    train = split.where("not is_valid").drop("is_valid")
    test = split.where("is_valid").drop("is_valid", "avg_tax", "revenue").withColumn("comment", F.lit("x"))
    return train, test


@query(
    "schema_and_drift",
    using("fx_model")
    + _SIDES
    + """, m as (select avg(n_lines) filter (not v) - avg(n_lines) filter (v) as a,
      avg(sum_qty) filter (not v) - avg(sum_qty) filter (v) as b,
      avg(avg_disc) filter (not v) - avg(avg_disc) filter (v) as c from sided)
    select 'avg_tax' as missing_columns, 'row_id,comment' as extra_columns, cast(1 as bigint) as n_missing, 'ok' as status,
      round((abs(a) + abs(b) + abs(c)) / 3, 6) as mean_abs_mean_shift from m""",
)
def drift(spark, sf_dir):
    train, test = _sides(spark, sf_dir)
    return rounded(M.schema_and_drift(train, test, ["n_lines", "sum_qty", "avg_disc", "avg_tax", "priority"]))


_SHIFT = "abs(0.01 * (3000.0 * stddev_samp(n_lines) + 1200.0 * stddev_samp(sum_qty)))"


@query("robustness_shift", using("fx_model") + f"select round({_SHIFT}, 6) as mean_prediction_shift from fx_model")
def robustness(spark, sf_dir):
    return rounded(M.linear_shift(view(spark, sf_dir, "fx_model"), _WEIGHTS))


_GATES = """select cast({k} as int) as case_id, relative_rmse, r2, target_std, mean_prediction_shift,
    cast(0 as bigint) as n_missing, relative_rmse <= 0.9 as gate_relative_rmse, r2 >= 0.3 as gate_r2,
    mean_prediction_shift <= 0.2 * greatest(target_std, 1e-8) as gate_shift, true as gate_schema,
    case when relative_rmse <= 0.9 and r2 >= 0.3 and mean_prediction_shift <= 0.2 * greatest(target_std, 1e-8)
      then 'ready' else 'needs_iteration' end as readiness,
    case when relative_rmse <= 0.9 and r2 >= 0.3 and mean_prediction_shift <= 0.2 * greatest(target_std, 1e-8) then null
      when mean_prediction_shift > 0.2 * greatest(target_std, 1e-8) then 'stability' else 'quality' end as focus,
    concat_ws('; ', case when relative_rmse > 0.9 then 'relative rmse too high' end,
      case when r2 < 0.3 then 'r2 too low' end,
      case when mean_prediction_shift > 0.2 * greatest(target_std, 1e-8) then 'unstable under a small shift' end) as reasons
    from ({source})"""
_CASE = """select round(sqrt(avg(({y} - ({p})) ** 2)) / greatest(stddev_samp({y}), 1e-8), 6) as relative_rmse,
    round(1 - avg(({y} - ({p})) ** 2) / var_pop({y}), 6) as r2, round(stddev_samp({y}), 6) as target_std,
    round({shift}, 6) as mean_prediction_shift from {t}"""


@query(
    "quality_gates",
    using("fx_model")
    + _GATES.format(k=1, source=_CASE.format(y="revenue", p=_SCORE, shift=_SHIFT, t="fx_model"))
    + " union all "
    + _GATES.format(
        k=2,
        source=_CASE.format(
            y="l_extendedprice", p="l_quantity * 1500.0", shift="15.0 * stddev_samp(l_quantity)", t="lineitem"
        ),
    ),
)
def gates(spark, sf_dir):
    def case(k, df, weights, target):
        score = sum(F.col(c) * F.lit(w) for c, w in weights.items())
        scored = df.withColumn("prediction", score)
        found = M.regression_metrics(scored, target, "prediction").select("relative_rmse", "r2", "target_std")
        shift = M.linear_shift(df, weights)
        return found.withColumns(
            {"mean_prediction_shift": shift.scalar(), "n_missing": F.lit(0).cast("bigint"), "case_id": F.lit(k)}
        )

    good = case(1, view(spark, sf_dir, "fx_model"), _WEIGHTS, "revenue")
    poor = case(2, table(spark, sf_dir, "lineitem"), {"l_quantity": 1500.0}, "l_extendedprice")
    return M.quality_gates(rounded(good.unionByName(poor)))
