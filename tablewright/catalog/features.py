"""Cleaning, groups, joins, places, splits and feature preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.catalog.registry import bucket_sql, query, rounded, table, using, view
from tablewright.functions.geo import (
    EARTH_RADIUS_KM,
    ELLIPSOID_FLATTENING,
    ELLIPSOID_MAJOR_KM,
    ellipsoid_km,
    haversine_km,
)
from tablewright.operators import clean as C
from tablewright.operators import groups as G
from tablewright.operators import prep as P
from tablewright.operators import split as S
from tablewright.operators.dictionary import fit_sparse_preprocessor
from tablewright.operators.places import nearest_place

_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "clean_rows",
    using("fx_orders_nulls")
    + """select coalesce(o_orderpriority, 'none') as o_orderpriority, o_custkey, o_orderkey, o_orderstatus, o_totalprice
      from fx_orders_nulls where o_totalprice is not null and o_custkey is not null and o_totalprice < 400000
      and o_orderstatus <> 'P'""",
)
def clean(spark, sf_dir):
    return C.clean_rows(
        view(spark, sf_dir, "fx_orders_nulls"),
        fill={"o_orderpriority": "none"},
        required=["o_totalprice", "o_custkey"],
        keep=(F.col("o_totalprice") < 400000) & (F.col("o_orderstatus") != "P"),
        drop=["dup_of_total", "empty_col", "const_col"],
    )


@query(
    "numeric_coerce",
    """select event_id, try_cast(json_extract_string(props, '$.k') as double) as k, try_cast(event_type as double) as t
    from events""",
)
def coerce(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "event_id", F.get_json_object("props", "$.k").alias("k"), F.col("event_type").alias("t")
    )
    return C.coerce_numbers(events, ["k", "t"])


@query(
    "flag_map",
    "select o_orderkey, case o_orderstatus when 'F' then 1 when 'P' then 1 when 'O' then 0 end as o_orderstatus from orders",
)
def flags(spark, sf_dir):
    return C.map_flags(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", {"F": 1, "P": 1, "O": 0}
    )


@query(
    "ratio_features",
    using("fx_model")
    + """select row_id, revenue / nullif(sum_qty, 0) as revenue_per_unit, sum_qty / n_lines as units_per_line,
      revenue / nullif(avg_tax, 0) as revenue_per_tax from fx_model""",
)
def ratios(spark, sf_dir):
    added = C.add_ratios(
        view(spark, sf_dir, "fx_model"),
        {
            "revenue_per_unit": ("revenue", "sum_qty"),
            "units_per_line": ("sum_qty", "n_lines"),
            "revenue_per_tax": ("revenue", "avg_tax"),
        },
    )
    return added.select("row_id", "revenue_per_unit", "units_per_line", "revenue_per_tax")


@query(
    "capped_bins",
    """select l_orderkey, l_linenumber, l_quantity, cast(least(ceil(l_quantity / 1.5), 5) as double) as bin,
    case when l_returnflag = 'R' then 'returned' else l_returnflag end as l_returnflag from lineitem""",
)
def bins(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    return C.replace_value(C.capped_bins(rows, "l_quantity", "bin"), "l_returnflag", "R", "returned")


@query(
    "group_mean",
    "select o_orderpriority, round(avg(o_totalprice), 4) as mean_value from orders group by o_orderpriority",
)
def means(spark, sf_dir):
    return rounded(G.group_mean(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice"), 4)


@query("group_count", "select o_custkey, count(*) as n from orders group by o_custkey")
def sizes(spark, sf_dir):
    return G.group_count(table(spark, sf_dir, "orders"), "o_custkey")


@query(
    "joined_group_stats",
    """with q as (select l_suppkey, avg(l_quantity) as mean_quantity from lineitem group by l_suppkey),
    p as (select l_suppkey, avg(l_extendedprice) as mean_price from lineitem group by l_suppkey),
    d as (select l_suppkey, avg(l_discount) as mean_discount from lineitem group by l_suppkey)
    select l_suppkey, round(mean_quantity, 6) as mean_quantity, round(mean_price, 6) as mean_price,
    round(mean_discount, 6) as mean_discount, round(mean_price / mean_quantity, 6) as price_per_unit
    from q join p using (l_suppkey) join d using (l_suppkey)""",
)
def joined(spark, sf_dir):
    return rounded(
        G.joined_group_stats(
            table(spark, sf_dir, "lineitem"),
            "l_suppkey",
            {"mean_quantity": "l_quantity", "mean_price": "l_extendedprice", "mean_discount": "l_discount"},
            ("price_per_unit", "mean_price", "mean_quantity"),
        )
    )


@query(
    "token_counts",
    using("fx_items")
    + "select item, count(*) as n from (select unnest(string_split(items, ',')) as item from fx_items) group by item",
)
def tokens(spark, sf_dir):
    return G.token_counts(view(spark, sf_dir, "fx_items"), "items")


_HELD = """, held as (select distinct row_id, target, item from (select row_id, target,
    unnest(string_split(trim(items), ',')) as item from fx_items) where item <> '')"""


@query(
    "multi_hot",
    using("fx_items")
    + _HELD
    + """, words as (select distinct item from held)
    select i.row_id, i.target, w.item as flag, cast(h.item is not null as int) as held
    from fx_items i cross join words w left join held h on h.row_id = i.row_id and h.item = w.item""",
)
def dummies(spark, sf_dir):
    wide = G.multi_hot(view(spark, sf_dir, "fx_items"), "items")
    flags = [c for c in wide.columns if c not in ("row_id", "target")]
    return wide.unpivot(["row_id", "target"], flags, "flag", "held")


@query(
    "mean_by_flag",
    using("fx_items") + _HELD + " select item as flag, round(avg(target), 6) as mean_target from held group by item",
)
def flag_means(spark, sf_dir):
    wide = G.multi_hot(view(spark, sf_dir, "fx_items"), "items")
    return rounded(G.mean_by_flag(wide, "target", [c for c in wide.columns if c not in ("row_id", "target")]))


@query(
    "semi_join",
    """select c_custkey, 'present' as side from customer where c_custkey in (select o_custkey from orders)
    union all select c_custkey, 'absent' from customer where c_custkey not in (select o_custkey from orders)""",
)
def members(spark, sf_dir):
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    present = G.present_in(customers, orders, "c_custkey", "o_custkey").select("c_custkey", F.lit("present").alias("side"))
    absent = G.absent_from(customers, orders, "c_custkey", "o_custkey").select("c_custkey", F.lit("absent").alias("side"))
    return present.unionAll(absent)


@query(
    "lookup_default",
    """select c_custkey, coalesce(n, 0) as orders_placed from customer left join (select o_custkey, count(*) as n
    from orders group by o_custkey) on o_custkey = c_custkey""",
)
def with_default(spark, sf_dir):
    placed = G.group_count(table(spark, sf_dir, "orders"), "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    return G.lookup(customers, placed, "c_custkey", "o_custkey", "n", "orders_placed", 0)


@query(
    "lookup_filter",
    using("fx_places")
    + """select l_orderkey, l_linenumber, l_suppkey, pop from lineitem join fx_places on place_id = l_suppkey
      where pop > 500000""",
)
def above(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return G.lookup(lines, view(spark, sf_dir, "fx_places"), "l_suppkey", "place_id", "pop", "pop").where("pop > 500000")


def _km_sql(a: str, b: str) -> str:
    h = (
        f"pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) "
        f"* pow(sin(radians({b}.lon - {a}.lon) / 2), 2)"
    )
    return f"{2 * EARTH_RADIUS_KM} * asin(least(1.0, sqrt({h})))"


def _nearest_sql(keep: str) -> str:
    return f"""(select point_id, place, km from (select point_id, place, km, row_number() over
        (partition by point_id order by km, place_id) as rn from (select p.point_id, c.place, c.place_id,
        round({_km_sql('p', 'c')}, 9) as km from fx_points p, fx_places c where {keep})) where rn = 1)"""


@query(
    "nearest_place",
    using("fx_points", "fx_places")
    + f"""select a.point_id, a.place as place, round(a.km, 6) as km, b.place as big_place, round(b.km, 6) as big_km
      from {_nearest_sql('true')} a join {_nearest_sql('c.pop > 500000')} b on a.point_id = b.point_id""",
)
def nearest(spark, sf_dir):
    points, places = view(spark, sf_dir, "fx_points"), view(spark, sf_dir, "fx_places")
    near = nearest_place(points, places)
    big = places.where("pop > 500000").withColumnRenamed("place", "big_place")
    both = nearest_place(near.withColumnRenamed("km", "near_km"), big, "big_place")
    return rounded(both.select("point_id", "place", F.col("near_km").alias("km"), "big_place", F.col("km").alias("big_km")))


def _customer_supplier_pairs(spark, sf_dir):
    """Each customer with one supplier, so that the customers go round all suppliers."""
    points = view(spark, sf_dir, "fx_points").withColumnsRenamed({"lat": "lat1", "lon": "lon1"})
    places = view(spark, sf_dir, "fx_places").select("place_id", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    last = places.agg(F.max("place_id")).scalar()
    return points.withColumn("__to", F.col("point_id") % (last + 1)).join(places, F.col("__to") == F.col("place_id"))


_PAIR_SQL = using("fx_points", "fx_places")
_PAIR_FROM = "fx_points p join fx_places c on c.place_id = p.point_id % (select max(place_id) + 1 from fx_places)"


@query("geo_distance", _PAIR_SQL + f" select point_id, place_id, round({_km_sql('p', 'c')}, 6) as km from {_PAIR_FROM}")
def distance(spark, sf_dir):
    pairs = _customer_supplier_pairs(spark, sf_dir)
    return rounded(pairs.select("point_id", "place_id", haversine_km(*map(F.col, ("lat1", "lon1", "lat2", "lon2"))).alias("km")))


def _vincenty_sql(source: str, rounds: int = 12) -> str:
    """Vincenty's iteration unrolled into nested selects, over pairs ``p`` and ``c``."""
    f, a = ELLIPSOID_FLATTENING, ELLIPSOID_MAJOR_KM
    b = (1 - f) * a
    level = f"""(select *, dl as lam from (select *, sin(u1) as s1, cos(u1) as c1, sin(u2) as s2, cos(u2) as c2 from (
        select point_id, place_id, atan({1 - f!r} * tan(radians(p.lat))) as u1, atan({1 - f!r} * tan(radians(c.lat))) as u2,
        radians(c.lon - p.lon) - 2 * pi() * floor((radians(c.lon - p.lon) + pi()) / (2 * pi())) as dl
        from {source})))"""
    state = """(select *, c16 * cos2a * (4 + {f!r} * (4 - 3 * cos2a)) as cc from (
        select *, case when cos2a < 1e-15 then 0 else cs - 2 * s1 * s2 / cos2a end as c2m from (
        select *, 1 - sa * sa as cos2a, atan2(ss, cs) as sg from (
        select *, case when ss = 0 then 0 else c1 * c2 * sin(lam) / ss end as sa, {f!r} / 16 as c16 from (
        select point_id, place_id, s1, c1, s2, c2, dl, lam,
        sqrt(pow(c2 * sin(lam), 2) + pow(c1 * s2 - s1 * c2 * cos(lam), 2)) as ss,
        s1 * s2 + c1 * c2 * cos(lam) as cs from {level})))))"""
    for _ in range(rounds):
        level = f"""(select point_id, place_id, s1, c1, s2, c2, dl, dl + (1 - cc) * {f!r} * sa * (sg + cc * ss * (c2m
            + cc * cs * (2 * c2m * c2m - 1))) as lam from {state.format(f=f, level=level)})"""
    return f"""select point_id, place_id, round({b!r} * ka * (sg - kb * ss * (c2m + kb / 4 * (cs * (2 * c2m * c2m - 1)
        - kb / 6 * c2m * (4 * ss * ss - 3) * (4 * c2m * c2m - 3)))), 6) as km from (
        select *, 1 + us / 16384 * (4096 + us * (-768 + us * (320 - 175 * us))) as ka,
        us / 1024 * (256 + us * (-128 + us * (74 - 47 * us))) as kb from (
        select *, cos2a * ({a!r} * {a!r} - {b!r} * {b!r}) / ({b!r} * {b!r}) as us from {state.format(f=f, level=level)}))"""


@query("geo_distance_ellipsoid", _PAIR_SQL + " " + _vincenty_sql(_PAIR_FROM))
def geodesic(spark, sf_dir):
    pairs = _customer_supplier_pairs(spark, sf_dir)
    return rounded(pairs.select("point_id", "place_id", ellipsoid_km("lat1", "lon1", "lat2", "lon2").alias("km")))


@query(
    "nearest_place_ellipsoid",
    using("fx_points", "fx_places")
    + f""", km as ({_vincenty_sql("fx_points p, fx_places c")})
      select point_id, place, km from (select point_id, place, km.km, row_number() over
        (partition by point_id order by km.km, place_id) as rn from km join fx_places using (place_id)) where rn = 1""",
)
def nearest_on_ellipsoid(spark, sf_dir):
    points, places = view(spark, sf_dir, "fx_points"), view(spark, sf_dir, "fx_places")
    near = nearest_place(points, places, metric="ellipsoid", km_digits=6)
    return near.select("point_id", "place", "km")


@query(
    "feature_subset",
    using("fx_orders_nulls")
    + " union all ".join(
        f"""select '{c}' as column_name, round(1 - count({c}) / count(*), 6) as missing_share,
        1 - count({c}) / count(*) < 0.98 as kept from fx_orders_nulls"""
        for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "empty_col", "const_col")
    ),
)
def subset(spark, sf_dir):
    return rounded(P.feature_subset(view(spark, sf_dir, "fx_orders_nulls"), "o_totalprice", ["dup_of_total"]))


@query(
    "impute_median",
    using("fx_orders_nulls")
    + """select o_orderkey, coalesce(o_totalprice, (select median(o_totalprice) from fx_orders_nulls)) as o_totalprice
      from fx_orders_nulls""",
)
def fill_median(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_orders_nulls").select("o_orderkey", "o_totalprice")
    return P.impute(rows, P.fit_medians(rows, ["o_totalprice"]))


@query(
    "impute_mode",
    using("fx_orders_nulls")
    + """select o_orderkey, coalesce(o_orderpriority, (select o_orderpriority from fx_orders_nulls where o_orderpriority
      is not null group by o_orderpriority order by count(*) desc, o_orderpriority limit 1)) as o_orderpriority
      from fx_orders_nulls""",
)
def fill_mode(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_orders_nulls").select("o_orderkey", "o_orderpriority")
    return P.impute(rows, P.fit_modes(rows, ["o_orderpriority"]))


@query(
    "standard_scale",
    """select l_orderkey, l_linenumber, round((l_quantity - m1) / s1, 6) as l_quantity,
    round((l_extendedprice - m2) / s2, 6) as l_extendedprice from lineitem, (select avg(l_quantity) as m1,
    stddev_pop(l_quantity) as s1, avg(l_extendedprice) as m2, stddev_pop(l_extendedprice) as s2 from lineitem)""",
)
def scale(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return rounded(P.standard_scale(rows, P.fit_scale(rows, ["l_quantity", "l_extendedprice"])))


@query(
    "one_hot",
    "select o_orderkey, "
    + ", ".join(f"cast(o_orderpriority = '{p}' as int) as \"o_orderpriority_{p}\"" for p in _PRIORITIES)
    + " from orders",
)
def encode(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return P.one_hot(orders, "o_orderpriority", P.fit_categories(orders, "o_orderpriority"))


@query(
    "preprocess",
    using("fx_orders_nulls")
    + """, med as (select median(o_totalprice) as m, (select o_orderpriority from fx_orders_nulls where o_orderpriority is
      not null group by o_orderpriority order by count(*) desc, o_orderpriority limit 1) as top from fx_orders_nulls),
    filled as (select o_orderkey, coalesce(o_totalprice, m) as v, coalesce(o_orderpriority, top) as t
      from fx_orders_nulls, med),
    scale as (select avg(v) as mu, stddev_pop(v) as sd from filled)
    select o_orderkey, round((v - mu) / sd, 6) as f0, """
    + ", ".join(
        f"cast(t = '{p}' as double) as f{i + 1}" for i, p in enumerate(p for p in _PRIORITIES if p != "3-MEDIUM")
    )
    + " from filled, scale",
)
def preprocess(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    rows = view(spark, sf_dir, "fx_orders_nulls")
    done = P.fit_preprocessor(rows, ["o_totalprice", "o_orderpriority"]).transform(rows)
    slots = vector_to_array("features")
    return rounded(done.select("o_orderkey", *[slots[i].alias(f"f{i}") for i in range(len(_PRIORITIES))]))


@query(
    "holdout_split",
    f"select o_orderkey, {bucket_sql('o_orderkey', 'holdout')} % 10000 < 2000 as is_valid from orders",
)
def holdout(spark, sf_dir):
    return S.holdout_split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query(
    "stratified_split",
    f"""select o_orderkey, o_orderpriority, row_number() over (partition by o_orderpriority order by
    {bucket_sql('o_orderkey')}, o_orderkey) <= floor(0.2 * count(*) over (partition by o_orderpriority)) as is_valid
    from orders""",
)
def stratified(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return S.stratified_split(orders, "o_orderkey", "o_orderpriority")


@query("kfold_assign", f"select o_orderkey, cast({bucket_sql('o_orderkey')} % 5 as int) as fold from orders")
def kfold(spark, sf_dir):
    return S.kfold_assign(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query(
    "stratified_kfold",
    f"""select o_orderkey, o_orderpriority, cast((row_number() over (partition by o_orderpriority order by
    {bucket_sql('o_orderkey')}, o_orderkey) - 1) % 5 as int) as fold from orders""",
)
def strat_kfold(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return S.stratified_kfold(orders, "o_orderkey", "o_orderpriority")


@query(
    "one_hot_wide",
    """with s as (select avg(c_acctbal) as m, stddev_pop(c_acctbal) as d, count(distinct c_name) as names, count(distinct c_mktsegment) as segments from customer)
    select c_custkey, round((c_acctbal - m) / d, 6) as scaled, dense_rank() over (order by c_name) as name_place,
           names + dense_rank() over (order by c_mktsegment) as segment_place, 1 + names + segments as width from customer, s""",
)
def one_hot_wide(spark, sf_dir):
    """A column with as many categories as rows, one with a few, and a number, as sparse vectors."""
    rows = table(spark, sf_dir, "customer")
    prep = fit_sparse_preprocessor(rows, ["c_acctbal", "c_name", "c_mktsegment"])
    found = prep.transform(rows).select(
        "c_custkey",
        F.col("values")[0].alias("scaled"),
        F.col("indices")[1].cast("bigint").alias("name_place"),
        F.col("indices")[2].cast("bigint").alias("segment_place"),
        F.lit(prep.width).cast("bigint").alias("width"),
    )
    return rounded(found)
