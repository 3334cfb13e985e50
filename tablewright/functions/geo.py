"""Distances on the earth."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Mean earth radius, WGS-84 semi-major axis (both km) and flattening.
EARTH_RADIUS_KM = 6371.0088
ELLIPSOID_MAJOR_KM = 6378.137
ELLIPSOID_FLATTENING = 1 / 298.257223563


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def vincenty_km(lat1, lon1, lat2, lon2, rounds: int = 50) -> np.ndarray:
    """Vincenty's inverse formula on arrays of degrees; the longitude on the auxiliary sphere is iterated."""
    f = ELLIPSOID_FLATTENING
    minor = (1 - f) * ELLIPSOID_MAJOR_KM
    u1, u2 = np.arctan((1 - f) * np.tan(np.radians(lat1))), np.arctan((1 - f) * np.tan(np.radians(lat2)))
    span = np.radians(np.asarray(lon2) - np.asarray(lon1))
    span = (span + np.pi) % (2 * np.pi) - np.pi
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam = span.copy()
    for _ in range(rounds):
        sl, cl = np.sin(lam), np.cos(lam)
        sin_sigma = np.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
        cos_sigma = s1 * s2 + c1 * c2 * cl
        sigma = np.arctan2(sin_sigma, cos_sigma)
        same = sin_sigma == 0
        sin_alpha = np.where(same, 0.0, c1 * c2 * sl / np.where(same, 1.0, sin_sigma))
        cos2_alpha = 1 - sin_alpha**2
        equator = cos2_alpha < 1e-15
        cos_2m = np.where(equator, 0.0, cos_sigma - 2 * s1 * s2 / np.where(equator, 1.0, cos2_alpha))
        c = f / 16 * cos2_alpha * (4 + f * (4 - 3 * cos2_alpha))
        new = span + (1 - c) * f * sin_alpha * (
            sigma + c * sin_sigma * (cos_2m + c * cos_sigma * (2 * cos_2m**2 - 1))
        )
        moved = np.max(np.abs(new - lam), initial=0.0)
        lam = new
        if moved < 1e-13:
            break
    u_sq = cos2_alpha * (ELLIPSOID_MAJOR_KM**2 - minor**2) / minor**2
    big_a = 1 + u_sq / 16384 * (4096 + u_sq * (-768 + u_sq * (320 - 175 * u_sq)))
    big_b = u_sq / 1024 * (256 + u_sq * (-128 + u_sq * (74 - 47 * u_sq)))
    d_sigma = big_b * sin_sigma * (
        cos_2m
        + big_b / 4 * (
            cos_sigma * (2 * cos_2m**2 - 1) - big_b / 6 * cos_2m * (4 * sin_sigma**2 - 3) * (4 * cos_2m**2 - 3)
        )
    )
    return minor * big_a * (sigma - d_sigma)


@F.pandas_udf(T.DoubleType())
def ellipsoid_km(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    """Geodesic distance on the ellipsoid, an Arrow batch at a time (the iteration has no column form)."""
    return pd.Series(vincenty_km(lat1.to_numpy(), lon1.to_numpy(), lat2.to_numpy(), lon2.to_numpy()))
