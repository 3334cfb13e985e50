import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.functions.geo import ellipsoid_km, haversine_km, vincenty_km
from tablewright.operators.places import nearest_place


def brute(points, places):
    lat1, lon1 = np.radians(points[["lat", "lon"]].to_numpy().T)
    lat2, lon2 = np.radians(places[["lat", "lon"]].to_numpy().T)
    h = np.sin((lat2 - lat1[:, None]) / 2) ** 2
    h = h + np.cos(lat1[:, None]) * np.cos(lat2) * np.sin((lon2 - lon1[:, None]) / 2) ** 2
    km = np.round(2 * 6371.0088 * np.arcsin(np.minimum(1, np.sqrt(h))), 9)
    return km.min(axis=1), places["place"].to_numpy()[km.argmin(axis=1)]


@pytest.mark.parametrize("leaf_places", [1, 5, 1000])
def test_nearest_matches_brute_force(spark, leaf_places):
    rng = np.random.default_rng(5)
    places = pd.DataFrame({"lat": rng.uniform(-89, 89, 300), "lon": rng.uniform(-180, 180, 300)})
    places.loc[100:199, ["lat", "lon"]] = rng.normal(50, 0.001, (100, 2))  # a dense cluster
    places.loc[200:249, ["lat", "lon"]] = (10.0, 20.0)  # many places at one spot
    places["place_id"], places["place"] = range(300), [f"p{i}" for i in range(300)]
    points = pd.DataFrame({"lat": rng.uniform(-90, 90, 200), "lon": rng.uniform(-180, 180, 200)})
    points.loc[:9, ["lat", "lon"]] = [(90.0, 0.0), (-90.0, 7.0), (0.0, 180.0), (0.0, -180.0), (10.0, 20.0)] * 2
    points.loc[50:120, ["lat", "lon"]] = rng.normal(50, 0.01, (71, 2))
    points["id"] = range(200)
    got = nearest_place(spark.createDataFrame(points), spark.createDataFrame(places), leaf_places=leaf_places)
    got = got.orderBy("id").toPandas()
    km, names = brute(points, places)
    assert got["km"].to_numpy() == pytest.approx(km, abs=1e-6)
    assert got["place"].tolist() == names.tolist()


@pytest.mark.parametrize("leaf_places", [2, 1000])
def test_nearest_on_the_ellipsoid(spark, leaf_places):
    rng = np.random.default_rng(6)
    places = pd.DataFrame({"lat": rng.uniform(-89, 89, 200), "lon": rng.uniform(-180, 180, 200)})
    places["place_id"], places["place"] = range(200), [f"p{i}" for i in range(200)]
    points = pd.DataFrame({"id": range(150), "lat": rng.uniform(-90, 90, 150), "lon": rng.uniform(-180, 180, 150)})
    got = nearest_place(
        spark.createDataFrame(points), spark.createDataFrame(places), leaf_places=leaf_places, metric="ellipsoid"
    )
    got = got.orderBy("id").toPandas()
    at = np.repeat(np.arange(150), 200), np.tile(np.arange(200), 150)
    pairs = (points["lat"][at[0]], points["lon"][at[0]], places["lat"][at[1]], places["lon"][at[1]])
    km = vincenty_km(*(x.to_numpy() for x in pairs)).reshape(150, 200)
    assert got["place"].tolist() == places["place"].to_numpy()[km.argmin(axis=1)].tolist()
    assert got["km"].to_numpy() == pytest.approx(km.min(axis=1), abs=1e-6)


def test_places_a_step_apart(spark):
    rng = np.random.default_rng(11)
    places = pd.DataFrame({"lat": 50 + rng.normal(0, 1e-7, 400), "lon": 8 + rng.normal(0, 1e-7, 400)})
    places["place_id"], places["place"] = range(400), [f"p{i}" for i in range(400)]
    points = pd.DataFrame({"id": range(40), "lat": 50 + rng.normal(0, 1e-7, 40), "lon": 8 + rng.normal(0, 1e-7, 40)})
    got = nearest_place(spark.createDataFrame(points), spark.createDataFrame(places), leaf_places=8)
    got = got.orderBy("id").toPandas()
    km, names = brute(points, places)
    assert got["km"].to_numpy() == pytest.approx(km, abs=2e-9)
    assert (got["place"] == names).mean() > 0.9  # equal to a micrometre, engines may round apart


def test_points_without_coordinates_are_kept(spark):
    places = spark.createDataFrame([(1, "a", 0.0, 0.0)], "place_id int, place string, lat double, lon double")
    points = spark.createDataFrame([(1, None, 2.0), (2, 1.0, 1.0)], "id int, lat double, lon double")
    got = {r["id"]: r["place"] for r in nearest_place(points, places).collect()}
    assert got == {1: None, 2: "a"}
    none = nearest_place(points, places.limit(0)).collect()
    assert len(none) == 2 and all(r["place"] is None for r in none)


def test_known_distances(spark):
    # the usual worked example, and a quarter meridian
    assert vincenty_km([41.49008], [-71.312796], [41.499498], [-81.695391])[0] == pytest.approx(866.4554, abs=1e-3)
    assert vincenty_km([0.0], [0.0], [90.0], [0.0])[0] == pytest.approx(10001.9657, abs=1e-3)
    assert vincenty_km([5.0], [5.0], [5.0], [5.0])[0] == 0
    df = spark.createDataFrame([(0.0, 179.0, 0.0, -179.0)], "a double, b double, c double, d double")
    row = df.select(
        haversine_km(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("h"), ellipsoid_km("a", "b", "c", "d").alias("e")
    ).first()
    assert row["h"] == pytest.approx(222.39, abs=0.01) and row["e"] == pytest.approx(222.639, abs=0.001)
