"""Geodesy: transverse Mercator by Krüger's series, geodesics by Vincenty's formulae.

Angles are degrees, lengths metres. UTM is one expression of built-in functions. Geodesics iterate, which
built-in functions can only do in interpreted lambdas, so they are numpy kernels over Arrow batches. A null
coordinate gives a null; nearly antipodal places have no distance that can be relied on.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: WGS 84 ellipsoid (GRS 80 differs below a tenth of a millimetre here) and UTM constants.
A, FLATTENING = 6378137.0, 1 / 298.257223563
B = A * (1 - FLATTENING)
UTM_SCALE, UTM_EAST = 0.9996, 500000.0
VINCENTY_STEPS = 10

N = FLATTENING / (2 - FLATTENING)
RECTIFYING = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
ALPHA = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180, 13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440, 61 * N**3 / 240 - 103 * N**4 / 140, 49561 * N**4 / 161280)
BETA = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360, N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440, 17 * N**3 / 480 - 37 * N**4 / 840, 4397 * N**4 / 161280)
DELTA = (2 * N - 2 * N**2 / 3 - 2 * N**3 + 116 * N**4 / 45, 7 * N**2 / 3 - 8 * N**3 / 5 - 227 * N**4 / 45, 56 * N**3 / 15 - 136 * N**4 / 35, 4279 * N**4 / 630)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body).getItem(0)


def utm_forward(lon: Column, lat: Column, zone: int = 33) -> Column:
    """Struct (east, north) on UTM's northern half."""
    phi, lam = F.radians(lat), F.radians(lon - (6 * zone - 183))
    e = 2 * N**0.5 / (1 + N)

    def planar(t: Column) -> Column:
        xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))

        def series(p: Column) -> Column:
            east = p["eta"] + sum(a * F.cos(2 * k * p["xi"]) * F.sinh(2 * k * p["eta"]) for k, a in enumerate(ALPHA, 1))
            north = p["xi"] + sum(a * F.sin(2 * k * p["xi"]) * F.cosh(2 * k * p["eta"]) for k, a in enumerate(ALPHA, 1))
            return F.struct((UTM_EAST + UTM_SCALE * RECTIFYING * east).alias("east"), (UTM_SCALE * RECTIFYING * north).alias("north"))

        return let(F.struct(xi.alias("xi"), eta.alias("eta")), series)

    return let(F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi))), planar)


def utm_inverse(east: Column, north: Column, zone: int = 33) -> Column:
    """Struct (lon, lat) from UTM's northern half."""
    planar = F.struct((north / (UTM_SCALE * RECTIFYING)).alias("xi"), ((east - UTM_EAST) / (UTM_SCALE * RECTIFYING)).alias("eta"))

    def angles(p: Column) -> Column:
        xi = p["xi"] - sum(b * F.sin(2 * k * p["xi"]) * F.cosh(2 * k * p["eta"]) for k, b in enumerate(BETA, 1))
        eta = p["eta"] - sum(b * F.cos(2 * k * p["xi"]) * F.sinh(2 * k * p["eta"]) for k, b in enumerate(BETA, 1))

        def degrees(q: Column) -> Column:
            chi = F.asin(F.sin(q["xi"]) / F.cosh(q["eta"]))
            lat = let(chi, lambda c: c + sum(d * F.sin(2 * k * c) for k, d in enumerate(DELTA, 1)))
            lon = F.atan2(F.sinh(q["eta"]), F.cos(q["xi"]))
            return F.struct((F.degrees(lon) + (6 * zone - 183)).alias("lon"), F.degrees(lat).alias("lat"))

        return let(F.struct(xi.alias("xi"), eta.alias("eta")), degrees)

    return let(planar, angles)


def reduced(lat: np.ndarray) -> np.ndarray:
    return np.arctan((1 - FLATTENING) * np.tan(np.radians(lat)))


def _series_ab(u2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    big_a = 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2)))
    big_b = u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2)))
    return big_a, big_b


def _delta_sigma(big_b: np.ndarray, sin_s: np.ndarray, cos_s: np.ndarray, cos_m: np.ndarray) -> np.ndarray:
    inner = cos_s * (-1 + 2 * cos_m * cos_m) - big_b / 6 * cos_m * (-3 + 4 * sin_s * sin_s) * (-3 + 4 * cos_m * cos_m)
    return big_b * sin_s * (cos_m + big_b / 4 * inner)


def _longitude_gain(sa: np.ndarray, ca2: np.ndarray, sigma: np.ndarray, ss: np.ndarray, cs: np.ndarray, cm: np.ndarray) -> np.ndarray:
    """What the ellipsoid takes off a difference of longitude on the auxiliary sphere."""
    c = FLATTENING / 16 * ca2 * (4 + FLATTENING * (4 - 3 * ca2))
    return (1 - c) * FLATTENING * sa * (sigma + c * ss * (cm + c * cs * (-1 + 2 * cm * cm)))


def inverse(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray, steps: int = VINCENTY_STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Metres between places, and the bearing at the first towards the second, from -180 to 180."""
    u1, u2, l = reduced(lat1), reduced(lat2), np.radians(lon2 - lon1)
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)

    def on_sphere(lam: np.ndarray) -> tuple[np.ndarray, ...]:
        ss = np.hypot(c2 * np.sin(lam), c1 * s2 - s1 * c2 * np.cos(lam))
        cs = s1 * s2 + c1 * c2 * np.cos(lam)
        sa = np.divide(c1 * c2 * np.sin(lam), ss, out=np.zeros_like(ss), where=ss > 0)
        ca2 = 1 - sa * sa
        cm = np.where(ca2 > 0, cs - 2 * np.divide(s1 * s2, ca2, out=np.zeros_like(ca2), where=ca2 > 0), 0)
        return sa, ca2, np.arctan2(ss, cs), ss, cs, cm

    lam = l
    for _ in range(steps):
        lam = l + _longitude_gain(*on_sphere(lam))
    _, ca2, sigma, ss, cs, cm = on_sphere(lam)
    big_a, big_b = _series_ab(ca2 * ((A * A - B * B) / (B * B)))
    metres = B * big_a * (sigma - _delta_sigma(big_b, ss, cs, cm))
    missing = np.isnan(l + u1 + u2)
    bearing = np.degrees(np.arctan2(c2 * np.sin(lam), c1 * s2 - s1 * c2 * np.cos(lam)))
    return np.where(missing, np.nan, metres), np.where(missing, np.nan, bearing)


def _by_libm(f: Callable[..., float]) -> Callable[..., np.ndarray]:
    """f of Python's math for whole arrays: numpy's own functions may differ from the system's library in the last bit."""

    def run(*values: np.ndarray) -> np.ndarray:
        lists = (np.asarray(v, float).ravel().tolist() for v in values)
        return np.fromiter(map(f, *lists), float).reshape(np.shape(values[0]))

    return run


def _plain(f: Callable[[float], float]) -> Callable[[float], float]:
    """f, with NaN where math has an error (sines of infinity)."""
    return lambda x: f(x) if -math.inf < x < math.inf else math.nan


SIN, COS, ATAN2 = _by_libm(_plain(math.sin)), _by_libm(_plain(math.cos)), _by_libm(math.atan2)


def direct(lon: np.ndarray, lat: np.ndarray, bearing: np.ndarray, metres: np.ndarray, steps: int = VINCENTY_STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Longitude and latitude at a distance along a bearing (degrees east of north)."""
    return _direct(lon, reduced(lat), np.radians(bearing), metres, steps)


def _direct(lon: np.ndarray, u: np.ndarray, az: np.ndarray, metres: np.ndarray, steps: int = VINCENTY_STEPS, sin: Callable = np.sin, cos: Callable = np.cos, atan2: Callable = np.arctan2) -> tuple[np.ndarray, np.ndarray]:
    """``direct`` of a reduced latitude and a bearing in radians."""
    su, cu, sz, cz = sin(u), cos(u), sin(az), cos(az)
    sa, sigma1 = cu * sz, atan2(su, cu * cz)
    ca2 = 1 - sa * sa
    big_a, big_b = _series_ab(ca2 * ((A * A - B * B) / (B * B)))
    first = sigma = metres / (B * big_a)
    for _ in range(steps):
        sigma = first + _delta_sigma(big_b, sin(sigma), cos(sigma), cos(2 * sigma1 + sigma))
    ss, cs, cm = sin(sigma), cos(sigma), cos(2 * sigma1 + sigma)
    flat = su * ss - cu * cs * cz
    lat2 = atan2(su * cs + cu * ss * cz, (1 - FLATTENING) * np.sqrt(sa * sa + flat * flat))
    lam = atan2(ss * sz, cu * cs - su * ss * cz)
    return lon + np.degrees(lam - _longitude_gain(sa, ca2, sigma, ss, cs, cm)), np.degrees(lat2)


def _kernel(kind: str, f: Callable[..., np.ndarray | tuple[np.ndarray, ...]], *columns: Column | float) -> Column:
    """f over Arrow batches of the columns (numbers are literals) as doubles; a tuple makes a struct."""
    names = [part.split(":")[0] for part in kind.removeprefix("struct<").split(",")]

    def run(*series: pd.Series) -> pd.Series:
        out = f(*(s.to_numpy(np.float64, na_value=np.nan) for s in series))
        return pd.DataFrame(dict(zip(names, out, strict=True))) if isinstance(out, tuple) else pd.Series(out)

    run.__annotations__ = {"series": pd.Series, "return": pd.DataFrame if kind.startswith("struct") else pd.Series}
    return F.pandas_udf(run, kind)(*(c.cast("double") if isinstance(c, Column) else F.lit(float(c)) for c in columns))


def geodesic_distance(lon1: Column | float, lat1: Column | float, lon2: Column | float, lat2: Column | float) -> Column:
    """Metres between two places, after a fixed number of iterations."""
    return _kernel("double", lambda *x: inverse(*x)[0], lon1, lat1, lon2, lat2)


def geodesic_direct(lon: Column | float, lat: Column | float, bearing: Column | float, metres: Column | float) -> Column:
    """Struct (lon, lat) at a distance along a bearing (degrees east of north)."""
    return _kernel("struct<lon:double,lat:double>", direct, lon, lat, bearing, metres)


def local_forward(lon: Column, lat: Column, lon0: float, lat0: float) -> Column:
    """Struct (x, y) of the azimuthal equidistant projection: distance and bearing from its centre."""

    def project(lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        far, turn = inverse(np.full_like(lon, lon0), np.full_like(lat, lat0), lon, lat)
        return far * np.sin(np.radians(turn)), far * np.cos(np.radians(turn))

    return _kernel("struct<x:double,y:double>", project, lon, lat)


def local_inverse(x: Column, y: Column, lon0: float, lat0: float) -> Column:
    """Struct (lon, lat) of a place of the azimuthal equidistant projection."""

    def place(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # The bearing stays in radians, and a rounding less here is a whole millimetre of some depth in millions.
        u = math.atan((1 - FLATTENING) * math.tan(lat0 * (math.pi / 180)))
        return _direct(np.full_like(x, lon0), np.full_like(y, u), ATAN2(x, y), np.sqrt(x * x + y * y), sin=SIN, cos=COS, atan2=ATAN2)

    return _kernel("struct<lon:double,lat:double>", place, x, y)


def geodesic_circles(places: DataFrame, radius: float, step: int = 5) -> DataFrame:
    """places (lon, lat) with n and v, the ring's n-th vertex (lon, lat), at bearings 0, step, ...; the first closes the ring."""
    ring = places.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(360 // step))))
    return ring.withColumn("v", geodesic_direct(F.col("lon"), F.col("lat"), F.col("n") * step % 360, radius))
