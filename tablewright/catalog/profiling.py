"""Dataset profile queries."""

from __future__ import annotations

from tablewright.catalog.registry import query, rounded, table, using, view
from tablewright.operators import profile as P

_NULLS = "o_orderkey o_custkey o_orderstatus o_totalprice dup_of_total o_orderpriority empty_col const_col".split()
_LINES = "l_quantity l_extendedprice l_discount l_tax".split()
_MODEL = "n_lines sum_qty avg_disc avg_tax revenue".split()


def _each(names, text: str) -> str:
    """One SELECT per column, ``{c}`` standing for its name."""
    return " union all ".join(text.replace("{c}", c) for c in names)


@query(
    "profile_dataset",
    using("fx_orders_nulls")
    + """select count(*) as "rows", cast(8 as bigint) as "columns",
      'o_orderkey,o_custkey,o_totalprice,dup_of_total,empty_col,const_col' as numeric_columns,
      'o_orderstatus,o_orderpriority' as categorical_columns,
      count(*) - (select count(*) from (select distinct * from fx_orders_nulls)) as duplicate_rows,
      'const_col,empty_col' as constant_columns, 'double' as target_dtype,
      round(avg(o_totalprice), 6) as mean, round(stddev_samp(o_totalprice), 6) as std, min(o_totalprice) as min,
      max(o_totalprice) as max, count(distinct o_totalprice) + 1 as n_unique from fx_orders_nulls""",
)
def profile(spark, sf_dir):
    return rounded(P.profile_dataset(view(spark, sf_dir, "fx_orders_nulls"), "o_totalprice"))


@query(
    "constant_columns",
    using("fx_orders_nulls")
    + "select column_name from ("
    + _each(
        [c for c in _NULLS if c != "o_totalprice"],
        "select '{c}' as column_name, count(distinct {c}) + max(cast({c} is null as int)) as n from fx_orders_nulls",
    )
    + ") where n <= 1",
)
def constants(spark, sf_dir):
    return P.constant_columns(view(spark, sf_dir, "fx_orders_nulls"), "o_totalprice")


@query(
    "target_summary",
    using("fx_orders_nulls")
    + """select count(*) as "rows", round(avg(o_totalprice), 6) as mean, round(stddev_samp(o_totalprice), 6) as std,
      min(o_totalprice) as min, max(o_totalprice) as max,
      count(distinct o_totalprice) + max(cast(o_totalprice is null as bigint)) as n_unique from fx_orders_nulls""",
)
def summary(spark, sf_dir):
    return rounded(P.target_summary(view(spark, sf_dir, "fx_orders_nulls"), "o_totalprice"))


@query(
    "leakage_report",
    using("fx_orders_nulls")
    + _each(
        [c for c in _NULLS if c != "o_totalprice"],
        """select '{c}' as column_name, regexp_matches('{c}', 'target|label|price|score|y|saleprice|loss') as name_flag,
        bool_and(try_cast({c} as double) is not distinct from o_totalprice) as equals_target from fx_orders_nulls""",
    ),
)
def leakage(spark, sf_dir):
    return P.leakage_report(view(spark, sf_dir, "fx_orders_nulls"), "o_totalprice")


@query(
    "missing_top",
    using("fx_orders_nulls")
    + "select column_name, n_missing from ("
    + _each(_NULLS, "select '{c}' as column_name, count(*) - count({c}) as n_missing from fx_orders_nulls")
    + ") where n_missing > 0 order by n_missing desc, column_name limit 15",
)
def top_missing(spark, sf_dir):
    return P.missing_top(view(spark, sf_dir, "fx_orders_nulls"))


@query(
    "missing_by_column",
    using("fx_orders_nulls")
    + " union all ".join(
        f"select '{c}' as column_name, '{t}' as dtype, count(*) - count({c}) as n_missing from fx_orders_nulls"
        for c, t in zip(_NULLS, ["bigint", "bigint", "string", "double", "double", "string", "double", "int"])
    ),
)
def missing(spark, sf_dir):
    return P.missing_by_column(view(spark, sf_dir, "fx_orders_nulls"))


@query(
    "target_balance",
    using("fx_orders_nulls")
    + """select o_orderpriority as value, count(*) as n, round(count(*) / (select count(o_orderpriority)
      from fx_orders_nulls), 6) as share from fx_orders_nulls where o_orderpriority is not null group by o_orderpriority""",
)
def balance(spark, sf_dir):
    return rounded(P.target_balance(view(spark, sf_dir, "fx_orders_nulls"), "o_orderpriority"))


@query(
    "target_correlation",
    using("fx_model")
    + _each(
        ["row_id", *[c for c in _MODEL if c != "revenue"]],
        "select '{c}' as column_name, round(corr({c}, revenue), 6) as r from fx_model",
    ),
)
def correlation(spark, sf_dir):
    return rounded(P.target_correlation(view(spark, sf_dir, "fx_model"), "revenue"))


_LINE_SQL = (
    "select '{c}' as column_name, regr_count({c}, revenue) as n, round(regr_slope({c}, revenue), 9) as slope, "
    "round(regr_intercept({c}, revenue), 6) + 0.0 as intercept, round(corr({c}, revenue), 6) as rvalue, "
    "round(sqrt(greatest(0, 1 - corr({c}, revenue) ^ 2) * regr_syy({c}, revenue) / regr_sxx({c}, revenue) "
    "/ (count(*) - 2)), 9) as stderr from fx_model"
)


@query("univariate_regression", using("fx_model") + _each(_MODEL, _LINE_SQL))
def lines(spark, sf_dir):
    return rounded(P.univariate_regression(view(spark, sf_dir, "fx_model"), "revenue", _MODEL), slope=9, stderr=9)


@query("univariate_p_value")
def p_values(spark, sf_dir):
    return rounded(P.with_p_value(P.univariate_regression(view(spark, sf_dir, "fx_model"), "revenue", _MODEL)))


@query(
    "describe_numeric",
    _each(
        _LINES,
        """select '{c}' as column_name, count({c}) as count, round(avg({c}), 6) as mean,
        round(stddev_samp({c}), 6) as std, min({c}) as min, round(quantile_cont({c}, 0.25), 6) as q25,
        round(quantile_cont({c}, 0.5), 6) as q50, round(quantile_cont({c}, 0.75), 6) as q75, max({c}) as max
        from lineitem""",
    ),
)
def describe(spark, sf_dir):
    return rounded(P.describe_numeric(table(spark, sf_dir, "lineitem").select(*_LINES)))


@query(
    "boxplot_stats",
    " union all ".join(
        f"""select '{c}' as column_name, round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3,
        round(q1 - 1.5 * (q3 - q1), 6) as lower_fence, round(q3 + 1.5 * (q3 - q1), 6) as upper_fence,
        (select count(*) from {t} where {c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1)) as outliers
        from (select quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.5) as median, quantile_cont({c}, 0.75) as q3
        from {t})"""
        for t, c in (("events", "value"),)
    ),
)
def boxplot(spark, sf_dir):
    return rounded(P.boxplot_stats(table(spark, sf_dir, "events"), ["value"]))


@query(
    "kde_grid",
    """with s as (select count(value) as n, min(value) as lo, max(value) as hi, stddev_samp(value) as sd from events),
    g as (select cast(p as int) as point, lo - 0.5 * (hi - lo) + p * (2.0 * (hi - lo) / 999) as x,
          sd * n ** (-0.2) as w, n from s, range(1000) r(p))
    select point, round(x, 6) as x, round(sum(exp(-0.5 * ((x - value) / w) ** 2)) / (n * w * sqrt(2 * pi())), 9) as density
    from g, events group by point, x, n, w""",
)
def density(spark, sf_dir):
    return rounded(P.kde_grid(table(spark, sf_dir, "events"), "value"), density=9)


@query("value_counts", "select event_type as value, count(*) as n from events group by event_type")
def counts(spark, sf_dir):
    return P.value_counts(table(spark, sf_dir, "events"), "event_type")
