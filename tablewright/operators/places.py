"""Nearest place on the sphere or the ellipsoid, exactly and without comparing every pair.

Places are packed into cells of a grid over the unit sphere in three dimensions, fine enough that a cell holds few
places. Cells nest, so a coarse cell is the list of its occupied children, each with the box its places span. Every
point walks down from the root and keeps the cells whose nearest box corner is no farther than the farthest corner
of its best cell. Only the places of the few surviving leaf cells are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.columns import number
from tablewright.functions.geo import EARTH_RADIUS_KM, ellipsoid_km, haversine_km
from tablewright.runtime import scratch_table

LEAF_PLACES = 32
BROADCAST_CELLS = 100_000
BROADCAST_PLACES = 500_000
_STEP = 2  # levels between a cell and its children
_USUAL_DEPTH = 20  # cells of some ten metres
_DEEPEST = 40  # cells of some ten micrometres
_AXES = ("x", "y", "z")
# The ellipsoid's radii of curvature lie between 0.9944 and 1.0045 mean radii, so its distances differ from those on the
# sphere by no more than these factors.
_SHORTER, _LONGER = 0.994, 1.005


def _on_sphere(df: DataFrame) -> DataFrame:
    lat, lon = F.radians("lat"), F.radians("lon")
    return df.withColumns({"x": F.cos(lat) * F.cos(lon), "y": F.cos(lat) * F.sin(lon), "z": F.sin(lat)})


def _with_cells(df: DataFrame) -> DataFrame:
    """Add the position in the finest grid per axis; coarser cells follow by shifting bits."""
    top = (1 << _DEEPEST) - 1
    places = {f"i{a}": F.floor((F.col(a) + 1) * F.lit(2.0 ** (_DEEPEST - 1))).cast("bigint") for a in _AXES}
    return df.withColumns({i: F.least(F.lit(top), p) for i, p in places.items()})


def _cell(level: int) -> Column:
    """Number of the grid cell at ``level`` (``2^level`` cells per axis).

    A hash: two cells that share a number are searched as one, with a box around both, which stays exact.
    """
    return F.xxhash64(*[F.shiftright(f"i{a}", _DEEPEST - level) for a in _AXES])


def _box_gap(far: bool) -> Column:
    """Chord from a point to the nearest (or farthest) spot of a cell's box."""
    total = F.lit(0.0)
    for a in _AXES:
        low, high, at = F.col(f"{a}0"), F.col(f"{a}1"), F.col(a)
        gap = F.greatest(F.abs(at - low), F.abs(at - high)) if far else F.greatest(low - at, at - high, F.lit(0.0))
        total = total + gap * gap
    return F.sqrt(total)


def nearest_place(
    points: DataFrame,
    places: DataFrame,
    name: str = "place",
    order: str = "place_id",
    leaf_places: int = LEAF_PLACES,
    km_digits: int = 9,
    metric: str = "haversine",
) -> DataFrame:
    """Add ``<name>`` and ``km`` of the nearest place to each point, by ``haversine`` or ``ellipsoid`` distance.

    Both tables have ``lat`` and ``lon`` in degrees. Distances are equal when they agree to ``km_digits`` decimals;
    the place first in ``order`` then wins. Points without coordinates get nulls.
    """
    if metric not in ("haversine", "ellipsoid"):
        raise ValueError(f"unknown metric {metric}")
    spots = (
        places.select(number(places, "lat").alias("lat"), number(places, "lon").alias("lon"), order, name)
        .where("lat is not null and lon is not null")
        .groupBy("lat", "lon")
        .agg(F.min(order).alias("ord"), F.min_by(name, order).alias("what"))
    )
    spots = scratch_table(_with_cells(_on_sphere(spots)), "spots")
    wanted = (
        points.select(number(points, "lat").alias("lat"), number(points, "lon").alias("lon"))
        .where("lat is not null and lon is not null")
        .distinct()
    )
    found = _walk_down(_on_sphere(wanted), spots, leaf_places, km_digits, metric == "ellipsoid")
    keyed = found.select(
        F.col("lat").alias("__lat"), F.col("lon").alias("__lon"), F.col("best.what").alias(name), F.col("best.km").alias("km")
    )
    same = (number(points, "lat") == F.col("__lat")) & (number(points, "lon") == F.col("__lon"))
    return points.join(keyed, same, "left").drop("__lat", "__lon")


def _level_sizes(spots: DataFrame, leaf_places: int) -> dict[int, tuple[int, int]]:
    """``{level: (places in the fullest cell, occupied cells)}``; one job, and another only for very dense spots."""
    sizes: dict[int, tuple[int, int]] = {}
    for levels in (range(0, _USUAL_DEPTH + 1, _STEP), range(_USUAL_DEPTH + _STEP, _DEEPEST + 1, _STEP)):
        cells = F.array(*[F.struct(F.lit(n).alias("level"), _cell(n).alias("cell")) for n in levels])
        counts = spots.select(F.inline(cells)).groupBy("level", "cell").agg(F.count("*").alias("n"))
        found = counts.groupBy("level").agg(F.max("n").alias("most"), F.count("*").alias("cells")).collect()
        sizes |= {r["level"]: (r["most"], r["cells"]) for r in found}
        if all(most > leaf_places for most, _ in sizes.values()) and sizes:
            continue
        break
    return sizes


def _angle(chord: Column) -> Column:
    return 2 * F.asin(F.least(F.lit(1.0), chord / 2))


def _walk_down(wanted: DataFrame, spots: DataFrame, leaf_places: int, km_digits: int, ellipsoid: bool) -> DataFrame:
    sizes = _level_sizes(spots, leaf_places)
    slack = 2 * 10.0**-km_digits / EARTH_RADIUS_KM + 1e-14  # places that agree to km_digits are all kept
    bottom = next((n for n in sorted(sizes) if sizes[n][0] <= leaf_places), _DEEPEST if sizes else 0)
    box = [F.min(a).alias(f"{a}0") for a in _AXES] + [F.max(a).alias(f"{a}1") for a in _AXES]
    held = _with_cells(wanted).withColumn("cell", _cell(0)).select("lat", "lon", *_AXES, "cell")
    best = Window.partitionBy("lat", "lon")
    may_win = F.col("near") <= F.col("reach") + F.lit(slack)
    if ellipsoid:
        may_win = _angle(F.col("near")) * _SHORTER <= _angle(F.col("reach")) * _LONGER + F.lit(slack)
    for level in range(_STEP, bottom + 1, _STEP):
        cells = spots.groupBy(_cell(level - _STEP).alias("cell"), _cell(level).alias("child")).agg(*box)
        if sizes[level][1] <= BROADCAST_CELLS:
            cells = F.broadcast(cells)
        held = (
            held.join(cells, "cell")
            .withColumns({"near": _box_gap(far=False), "far": _box_gap(far=True)})
            .withColumn("reach", F.min("far").over(best))
            .where(may_win)
            .select("lat", "lon", *_AXES, F.col("child").alias("cell"))
        )
    # a leaf holds at most leaf_places spots (more only where spots lie within micrometres of each other)
    leaves = spots.groupBy(_cell(bottom).alias("cell")).agg(
        F.collect_list(F.struct("lat", "lon", "ord", "what")).alias("spots")
    )
    if sizes and sizes[0][0] <= BROADCAST_PLACES:  # the root holds all places
        leaves = F.broadcast(leaves)
    ranked = F.transform(
        "spots",
        lambda s: F.struct(
            F.round(haversine_km(F.col("lat"), F.col("lon"), s["lat"], s["lon"]), km_digits).alias("km"),
            s["ord"].alias("ord"),
            s["what"].alias("what"),
            s["lat"].alias("plat"),
            s["lon"].alias("plon"),
        ),
    )
    joined = held.join(leaves, "cell")
    if not ellipsoid:
        nearest = joined.select("lat", "lon", F.array_min(ranked).alias("best"))
        return nearest.groupBy("lat", "lon").agg(F.min("best").alias("best"))
    # the sphere leaves a place or two per point, for which the longer formula is worked out
    measured = joined.select("lat", "lon", ranked.alias("on_sphere")).withColumn(
        "reach", F.min(F.array_min("on_sphere")["km"]).over(best)
    )
    close = F.filter("on_sphere", lambda s: s["km"] * _SHORTER <= F.col("reach") * _LONGER + F.lit(1e-6))
    pairs = measured.select("lat", "lon", F.inline(close))
    exact = F.round(ellipsoid_km("lat", "lon", "plat", "plon"), km_digits)
    scored = pairs.select("lat", "lon", F.struct(exact.alias("km"), "ord", "what").alias("best"))
    return scored.groupBy("lat", "lon").agg(F.min("best").alias("best"))
