"""Distances on the WGS-84 ellipsoid, and a nested latitude/longitude grid, as column expressions."""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Executors get the distance function by value and need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# WGS-84 semi-major axis, flattening, and the mean Earth radius (metres).
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
MEAN_RADIUS = 6371008.8

WGS84_B = WGS84_A * (1 - WGS84_F)

# The ellipsoid's local scale against the mean sphere lies in [0.99442, 1.00449] in every direction, so
# geodesic / haversine lies between these two for any pair of points.
SPHERE_LOW = 0.9944
SPHERE_HIGH = 1.0045

# Shortest length of one degree of latitude (metres), rounded down.
LAT_DEGREE_MIN = 110500.0

FINEST_LEVEL = 24


def pin(df: DataFrame, keep: list[str], **exprs: Column) -> DataFrame:
    """Compute ``exprs`` once and hold them.

    A filter on a computed column is pushed below the projection by substituting the whole expression;
    where one value is used many times that repeats the work at every use. Rows of a generator are a
    boundary for that push-down, so a one-row generator keeps each value computed once per row.
    """
    packed = F.array(F.struct(*[e.alias(n) for n, e in exprs.items()]))
    return df.select(*keep, F.inline(packed))


def haversine_unit(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine term of two points given in degrees (0 .. 1)."""
    s_lat = F.sin(F.radians(lat2 - lat1) / 2)
    s_lon = F.sin(F.radians(lon2 - lon1) / 2)
    return s_lat * s_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s_lon * s_lon


def unit_to_m(unit: Column) -> Column:
    return F.lit(2 * MEAN_RADIUS) * F.asin(F.sqrt(F.least(F.lit(1.0), unit)))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres: within 0.56 % of the geodesic."""
    return unit_to_m(haversine_unit(lat1, lon1, lat2, lon2))


def geodesic_m(lat1, lon1, lat2, lon2) -> np.ndarray:
    """Geodesic distance in metres on arrays of degrees, for any two places on the ellipsoid.

    Vincenty's inverse formula (1975) settles all pairs but those nearly opposite each other; what it has not settled
    after ``ROUNDS`` rounds is solved by the azimuth (``azimuth_m``), which always converges. NaN stays NaN.
    """
    lat1, lon1, lat2, lon2 = np.broadcast_arrays(*(np.atleast_1d(np.asarray(x, dtype=float)) for x in (lat1, lon1, lat2, lon2)))
    dist, settled = _vincenty(lat1, lon1, lat2, lon2)
    left = ~settled & np.isfinite(lat1 + lon1 + lat2 + lon2)
    if left.any():
        dist = dist.copy()
        dist[left] = azimuth_m(lat1[left], lon1[left], lat2[left], lon2[left])
    return dist


ROUNDS = 20
_NODES, _SHARES = np.polynomial.legendre.leggauss(20)


def azimuth_m(lat1, lon1, lat2, lon2) -> np.ndarray:
    """Geodesic distance by the azimuth at the first place: the longitude that a geodesic reaches grows with it, so a bracket
    closes on the right one, by secant steps kept inside and by halving where they gain too little. Integrals along the
    line are Gauss sums; their integrands are nearly constant."""
    f = WGS84_F
    span = np.abs(np.remainder(np.radians(lon2 - lon1) + np.pi, 2 * np.pi) - np.pi)
    # the place farther from the equator first, in the south
    swap = np.abs(lat1) < np.abs(lat2)
    south, other = np.where(swap, lat2, lat1), np.where(swap, lat1, lat2)
    flip = np.where(south > 0, -1.0, 1.0)
    u1, u2 = (np.arctan((1 - f) * np.tan(np.radians(x * flip))) for x in (south, other))
    sin1, sin2 = np.minimum(np.sin(u1), -1e-200), np.sin(u2)
    cos1, cos2 = np.maximum(np.cos(u1), 1e-100), np.maximum(np.cos(u2), 1e-100)

    def line(azimuth):
        """Longitude reached, and distance."""
        sin_a, cos_a = np.sin(azimuth), np.cos(azimuth)
        sin0 = sin_a * cos1
        cos_a2 = np.sqrt(np.maximum((cos_a * cos1) ** 2 + (cos2**2 - cos1**2), 0)) / cos2
        s1, s2 = np.arctan2(sin1, cos_a * cos1), np.arctan2(sin2, cos_a2 * cos2)
        w1, w2 = np.arctan2(sin0 * np.sin(s1), np.cos(s1)), np.arctan2(sin0 * np.sin(s2), np.cos(s2))
        half = (s2 - s1) / 2
        k2 = (WGS84_A**2 / WGS84_B**2 - 1) * (1 - sin0**2)
        root = np.sqrt(1 + k2 * np.sin((s1 + s2) / 2 + half * _NODES[:, None]) ** 2)
        longitude = w2 - w1 - f * sin0 * half * (_SHARES @ ((2 - f) / (1 + (1 - f) * root)))
        return longitude, WGS84_B * half * (_SHARES @ root)

    low, high = np.zeros_like(span), np.full_like(span, np.pi)
    below, above = line(low)[0] - span, line(high)[0] - span
    for step in range(200):
        with np.errstate(divide="ignore", invalid="ignore"):
            secant = low - below * (high - low) / (above - below)
        middle = (low + high) / 2
        at = np.where((step % 3 < 2) & (secant > low) & (secant < high), secant, middle)
        off = line(at)[0] - span
        under = off < 0
        low, below = np.where(under, at, low), np.where(under, off, below)
        high, above = np.where(under, high, at), np.where(under, above, off)
        if np.all((high - low < 1e-15) | (off == 0)):
            break
    best = np.where(np.abs(below) < np.abs(above), low, high)
    return line(best)[1]


def _vincenty(lat1, lon1, lat2, lon2) -> tuple[np.ndarray, np.ndarray]:
    """Distances, and whether each has converged."""
    f = WGS84_F
    u1, u2 = (np.arctan((1 - f) * np.tan(np.radians(x))) for x in (lat1, lat2))
    sin1, cos1, sin2, cos2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    start = np.radians(lon2 - lon1)
    lam = start
    for _ in range(ROUNDS):
        sin_lam, cos_lam = np.sin(lam), np.cos(lam)
        sin_sig = np.hypot(cos2 * sin_lam, cos1 * sin2 - sin1 * cos2 * cos_lam)
        cos_sig = sin1 * sin2 + cos1 * cos2 * cos_lam
        sig = np.arctan2(sin_sig, cos_sig)
        apart = sin_sig > 0
        sin_az = np.where(apart, cos1 * cos2 * sin_lam / np.where(apart, sin_sig, 1.0), 0.0)
        cos2_az = 1 - sin_az * sin_az
        off_equator = cos2_az > 0
        mid = np.where(off_equator, cos_sig - 2 * sin1 * sin2 / np.where(off_equator, cos2_az, 1.0), 0.0)
        c = f / 16 * cos2_az * (4 + f * (4 - 3 * cos2_az))
        ahead = start + (1 - c) * f * sin_az * (sig + c * sin_sig * (mid + c * cos_sig * (2 * mid * mid - 1)))
        settled = (np.abs(ahead - lam) <= 1e-12) & (np.abs(np.remainder(start + np.pi, 2 * np.pi) - np.pi + ahead - start) <= np.pi)
        done = not np.any(np.abs(ahead - lam) > 1e-15)
        lam = ahead
        if done:
            break
    q = cos2_az * (WGS84_A**2 - WGS84_B**2) / WGS84_B**2
    big_a = 1 + q / 16384 * (4096 + q * (-768 + q * (320 - 175 * q)))
    big_b = q / 1024 * (256 + q * (-128 + q * (74 - 47 * q)))
    turn = cos_sig * (2 * mid * mid - 1) - big_b / 6 * mid * (4 * sin_sig**2 - 3) * (4 * mid * mid - 3)
    return WGS84_B * big_a * (sig - big_b * sin_sig * (mid + big_b / 4 * turn)), settled


@F.arrow_udf(T.DoubleType())
def _geodesic(lat1: pa.Array, lon1: pa.Array, lat2: pa.Array, lon2: pa.Array) -> pa.Array:
    places = [x.cast(pa.float64()).to_numpy(zero_copy_only=False) for x in (lat1, lon1, lat2, lon2)]
    return pa.array(geodesic_m(*places), from_pandas=True)


def with_geodesic(
    df: DataFrame, lat1: str, lon1: str, lat2: str, lon2: str, out: str = "dist_m"
) -> DataFrame:
    """Add the geodesic distance in metres as column ``out`` (NULL where a coordinate is NULL).

    Arrow batches through numpy: unrolled as built-in expressions the formula makes a generated method
    too large for the JIT compiler as soon as an aggregate is fused to it, and runs five times slower.
    """
    return pin(df, df.columns, **{out: _geodesic(lat1, lon1, lat2, lon2)})


# ---- grid -------------------------------------------------------------------------------------------
# Level n cuts 180 degrees into 2**n steps. The step is a power of two times 45, so a cell's number
# shifted right by k is exactly its ancestor's number k levels up.


def step_degrees(level: int) -> float:
    return 180.0 / 2**level


def level_for(size_m: float) -> int:
    """Finest level whose cells are at least ``size_m`` metres high."""
    level = int(math.floor(math.log2(180.0 * LAT_DEGREE_MIN / size_m)))
    return max(0, min(FINEST_LEVEL, level))


def lat_cell(lat: Column, level: int) -> Column:
    last = 2**level - 1
    raw = F.floor((lat + 90.0) / step_degrees(level)).cast("long")
    return F.greatest(F.lit(0).cast("long"), F.least(F.lit(last).cast("long"), raw))


def lon_cell(lon: Column, level: int) -> Column:
    raw = F.floor((lon + 180.0) / step_degrees(level)).cast("long")
    return F.pmod(raw, F.lit(2 ** (level + 1)).cast("long"))


def cell_low(cell: Column, level: int, axis_min: float) -> Column:
    return cell * step_degrees(level) + axis_min


def cover_lat_cells(lat: Column, radius_m: float, level: int, size: float = 0.0) -> Column:
    """Latitude cells within ``radius_m`` of a box with south edge ``lat`` (size 0: a point)."""
    reach = radius_m / LAT_DEGREE_MIN
    return F.sequence(lat_cell(lat - reach, level), lat_cell(lat + size + reach, level))


def cover_lon_cells(lat: Column, lon: Column, radius_m: float, level: int, size: float = 0.0) -> Column:
    """Longitude cells within ``radius_m`` of the box; wraps at 180 degrees, all cells around a pole."""
    delta = radius_m / SPHERE_LOW / MEAN_RADIUS
    top = F.least(F.greatest(F.abs(lat), F.abs(lat + size)), F.lit(90.0))
    ratio = F.lit(math.sin(min(delta, math.pi / 2))) / F.cos(F.radians(top))
    over_pole = F.radians(top) + delta >= math.pi / 2
    reach = F.when(over_pole | (ratio >= 1.0), 180.0).otherwise(F.degrees(F.asin(ratio)))
    n = 2 ** (level + 1)
    first = F.floor((lon - reach + 180.0) / step_degrees(level)).cast("long")
    final = F.floor((lon + size + reach + 180.0) / step_degrees(level)).cast("long")
    final = F.least(final, first + (n - 1))
    return F.transform(F.sequence(first, final), lambda c: F.pmod(c, F.lit(n).cast("long")))


def _cos_deg(x: Column) -> Column:
    return F.cos(F.radians(x))


def box_bounds_m(
    lat_a: Column, lon_a: Column, size_a: float, lat_b: Column, lon_b: Column, size_b: float
) -> tuple[Column, Column]:
    """Lower and upper bound (metres) of the geodesic between any point of box A and any point of box B.

    A box is its south-west corner and its size in degrees; size 0 is a point.
    """
    gap_lat = F.greatest(lat_a - (lat_b + size_b), lat_b - (lat_a + size_a), F.lit(0.0))
    span_lat = F.greatest(lat_a + size_a - lat_b, lat_b + size_b - lat_a)
    turn = F.abs((lon_a + size_a / 2) - (lon_b + size_b / 2))
    centre = F.least(turn, 360.0 - turn)
    half = (size_a + size_b) / 2
    gap_lon = F.greatest(centre - half, F.lit(0.0))
    span_lon = F.least(centre + half, F.lit(180.0))

    def cos_low(lat: Column, size: float) -> Column:
        if size == 0:
            return _cos_deg(lat)
        return F.greatest(F.lit(0.0), F.least(_cos_deg(lat), _cos_deg(lat + size)))

    def cos_high(lat: Column, size: float) -> Column:
        if size == 0:
            return _cos_deg(lat)
        crosses = (lat <= 0) & (lat + size >= 0)
        return F.when(crosses, 1.0).otherwise(F.greatest(_cos_deg(lat), _cos_deg(lat + size)))

    def unit(d_lat: Column, d_lon: Column, cos_cos: Column) -> Column:
        s_lat, s_lon = F.sin(F.radians(d_lat) / 2), F.sin(F.radians(d_lon) / 2)
        return s_lat * s_lat + cos_cos * s_lon * s_lon

    low = unit(gap_lat, gap_lon, cos_low(lat_a, size_a) * cos_low(lat_b, size_b))
    high = unit(span_lat, span_lon, cos_high(lat_a, size_a) * cos_high(lat_b, size_b))
    return unit_to_m(low) * SPHERE_LOW, unit_to_m(high) * SPHERE_HIGH


def inside_box(lat: Column, lon: Column, south: float, north: float, west: float, east: float) -> Column:
    """Strictly inside a bounding box; plain comparisons, so the filter reaches the file scan."""
    return (lat > south) & (lat < north) & (lon > west) & (lon < east)


# Fixed values: (south, north, west, east) of the two regions.
COUNTY_BOX = (40.0, 40.87, -80.55, -79.5)
USA_BOX = (25.11667, 49.04, -125.666666, -59.815)


def decay_weight(dist: Column, radius_m: float) -> Column:
    """Linear decay, 1 at the centre and 0 at the radius."""
    return 1 - dist / radius_m


def quadrant(lat: Column, lon: Column, mid_lat: Column, mid_lon: Column) -> Column:
    """1 = north-east, 2 = north-west, 3 = south-west, 4 = south-east of the given centre."""
    north, east = lat >= mid_lat, lon >= mid_lon
    return F.when(north & east, 1).when(north, 2).when(~east, 3).otherwise(4)
