"""Geodesy: column expressions on the sphere, numpy for the ellipsoid.  Angles in degrees,
lengths in metres."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

A = 6378137.0
INVERSE_FLATTENING = 298.257223563
B = A * (1 - 1 / INVERSE_FLATTENING)
RADIUS = (2 * A + B) / 3
ECCENTRICITY2 = 1 - (B * B) / (A * A)
#: Step of the local projection's numerical scale, in degrees.
DELTA = 1e-2


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * RADIUS) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def vincenty_sphere(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y = F.sqrt(F.pow(F.cos(p2) * F.sin(d), 2) + F.pow(F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d), 2))
    return F.lit(RADIUS) * F.atan2(y, F.sin(p1) * F.sin(p2) + F.cos(p1) * F.cos(p2) * F.cos(d))


def sphere_azimuth(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.degrees(F.atan2(F.sin(d) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d)))


def sphere_direct(lon: Column, lat: Column, azimuth: Column, distance: Column) -> tuple[Column, Column]:
    p, a, d = F.radians(lat), F.radians(azimuth), distance / F.lit(RADIUS)
    s = F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(a)
    lat2 = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s)))
    lon2 = F.radians(lon) + F.atan2(F.sin(a) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * s)
    return F.degrees(lon2), F.degrees(lat2)


def unit_xyz(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    return F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.sin(F.radians(lat))


def xyz_to_lonlat(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    return F.degrees(F.atan2(y, x)), F.degrees(F.atan2(z, F.sqrt(x * x + y * y)))


def spheroid_xyz(lon: Column, lat: Column, height: Column) -> tuple[Column, Column, Column]:
    n = F.lit(A) / F.sqrt(1 - F.lit(ECCENTRICITY2) * F.pow(F.sin(F.radians(lat)), 2))
    return (n + height) * F.cos(F.radians(lat)) * F.cos(F.radians(lon)), (n + height) * F.cos(F.radians(lat)) * F.sin(F.radians(lon)), (n * F.lit(B * B / (A * A)) + height) * F.sin(F.radians(lat))


def local_projection(lon: Column, lat: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """Plane coordinates about an origin: each axis scaled by the metres of DELTA degrees there."""
    sx = haversine(lon0, lat0, lon0 + DELTA, lat0) / F.lit(DELTA)
    sy = haversine(lon0, lat0, lon0, lat0 + DELTA) / F.lit(DELTA)
    return (lon - lon0) * sx, (lat - lat0) * sy


def local_unprojection(x: Column, y: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    sx = haversine(lon0, lat0, lon0 + DELTA, lat0) / F.lit(DELTA)
    sy = haversine(lon0, lat0, lon0, lat0 + DELTA) / F.lit(DELTA)
    return lon0 + x / sx, lat0 + y / sy


def dot(a: tuple, b: tuple) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + x * y
    return out


def cross(a: tuple, b: tuple) -> tuple:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: tuple) -> Column:
    return F.sqrt(dot(a, a))


def projection_factor(p: tuple, a: tuple, b: tuple) -> Column:
    """Where along the segment a-b the foot of p lies (0 at a, 1 at b)."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    return F.coalesce(F.try_divide((p[0] - a[0]) * dx + (p[1] - a[1]) * dy, dx * dx + dy * dy), F.lit(0.0))


def segment_distance(p: tuple, a: tuple, b: tuple) -> Column:
    f = F.greatest(F.lit(0.0), F.least(F.lit(1.0), projection_factor(p, a, b)))
    dx, dy = p[0] - (a[0] + f * (b[0] - a[0])), p[1] - (a[1] + f * (b[1] - a[1]))
    return F.sqrt(dx * dx + dy * dy)


def geo_uri(lon: Column, lat: Column, elevation: Column | None = None, uncertainty: Column | None = None) -> Column:
    return _geo_uri(lon, lat, elevation if elevation is not None else F.lit(None).cast("double"), uncertainty if uncertainty is not None else F.lit(None).cast("double"))


def plain_number(x: float) -> str:
    """Shortest decimal that reads back as the same double, without exponent."""
    from decimal import Decimal

    text = format(Decimal(repr(float(x))), "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


def geo_uri_of(lon: float, lat: float, elevation: float | None, uncertainty: float | None) -> str:
    have = lambda x: x is not None and x == x
    return f"geo:{plain_number(lat)},{plain_number(lon)}" + (f",{plain_number(elevation)}" if have(elevation) else "") + (f";u={plain_number(uncertainty)}" if have(uncertainty) else "")


@F.pandas_udf(T.StringType())
def _geo_uri(lon: pd.Series, lat: pd.Series, elevation: pd.Series, uncertainty: pd.Series) -> pd.Series:
    return pd.Series([None if math.isnan(x) or math.isnan(y) else geo_uri_of(x, y, e, u) for x, y, e, u in zip(lon, lat, elevation, uncertainty, strict=True)])


def parse_geo_uri(x: Column) -> Column:
    part = lambda i: F.regexp_extract(x, r"^geo:(-?[\d.]+),(-?[\d.]+)(?:,(-?[\d.]+))?(?:;u=([\d.]+))?$", i).try_cast("double")
    return F.when(part(1).isNotNull(), F.struct(part(2).alias("lon"), part(1).alias("lat"), part(3).alias("elevation"), part(4).alias("uncertainty")))


# -- ellipsoid (Vincenty's series), vectorised


def ellipsoid_inverse(lon1, lat1, lon2, lat2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distance and azimuths; pairs that do not converge (near antipodes) fall back to the sphere."""
    f = 1 / INVERSE_FLATTENING
    lon1, lat1, lon2, lat2 = (np.asarray(x, float) for x in (lon1, lat1, lon2, lat2))
    u1, u2 = np.arctan((1 - f) * np.tan(np.radians(lat1))), np.arctan((1 - f) * np.tan(np.radians(lat2)))
    ell = np.radians((lon2 - lon1 + 180) % 360 - 180)
    lam = ell.copy()
    for _ in range(100):
        sl, cl = np.sin(lam), np.cos(lam)
        ss = np.hypot(np.cos(u2) * sl, np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * cl)
        cs = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * cl
        sigma = np.arctan2(ss, cs)
        sa = np.where(ss == 0, 0.0, np.cos(u1) * np.cos(u2) * sl / np.where(ss == 0, 1, ss))
        ca2 = 1 - sa * sa
        cm = np.where(ca2 == 0, 0.0, cs - 2 * np.sin(u1) * np.sin(u2) / np.where(ca2 == 0, 1, ca2))
        c = f / 16 * ca2 * (4 + f * (4 - 3 * ca2))
        new = ell + (1 - c) * f * sa * (sigma + c * ss * (cm + c * cs * (2 * cm * cm - 1)))
        done = np.abs(new - lam) < 1e-12
        lam = new
        if done.all():
            break
    k = ca2 * (A * A - B * B) / (B * B)
    big_a = 1 + k / 16384 * (4096 + k * (k * (320 - 175 * k) - 768))
    big_b = k / 1024 * (256 + k * (k * (74 - 47 * k) - 128))
    delta = big_b * ss * (cm + big_b / 4 * (cs * (2 * cm * cm - 1) - big_b / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))
    s = B * big_a * (sigma - delta)
    a1 = np.degrees(np.arctan2(np.cos(u2) * np.sin(lam), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam)))
    a2 = np.degrees(np.arctan2(np.cos(u1) * np.sin(lam), np.cos(u1) * np.sin(u2) * np.cos(lam) - np.sin(u1) * np.cos(u2)))
    p1, p2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(ell / 2) ** 2
    return np.where(done, s, 2 * RADIUS * np.arcsin(np.minimum(1, np.sqrt(h)))), a1, a2


def ellipsoid_direct(lon, lat, azimuth, distance) -> tuple[np.ndarray, np.ndarray]:
    f = 1 / INVERSE_FLATTENING
    a1, s = np.radians(np.asarray(azimuth, float)), np.asarray(distance, float)
    tan_u = (1 - f) * np.tan(np.radians(np.asarray(lat, float)))
    u1 = np.arctan(tan_u)
    sigma1 = np.arctan2(tan_u, np.cos(a1))
    sa = np.cos(u1) * np.sin(a1)
    ca2 = 1 - sa * sa
    k = ca2 * (A * A - B * B) / (B * B)
    big_a = 1 + k / 16384 * (4096 + k * (k * (320 - 175 * k) - 768))
    big_b = k / 1024 * (256 + k * (k * (74 - 47 * k) - 128))
    sigma = s / (B * big_a)
    for _ in range(100):
        cm = np.cos(2 * sigma1 + sigma)
        delta = big_b * np.sin(sigma) * (cm + big_b / 4 * (np.cos(sigma) * (2 * cm * cm - 1) - big_b / 6 * cm * (4 * np.sin(sigma) ** 2 - 3) * (4 * cm * cm - 3)))
        new = s / (B * big_a) + delta
        done = np.all(np.abs(new - sigma) < 1e-12)
        sigma = new
        if done:
            break
    x = np.sin(u1) * np.sin(sigma) - np.cos(u1) * np.cos(sigma) * np.cos(a1)
    lat2 = np.arctan2(np.sin(u1) * np.cos(sigma) + np.cos(u1) * np.sin(sigma) * np.cos(a1), (1 - f) * np.hypot(sa, x))
    lam = np.arctan2(np.sin(sigma) * np.sin(a1), np.cos(u1) * np.cos(sigma) - np.sin(u1) * np.sin(sigma) * np.cos(a1))
    c = f / 16 * ca2 * (4 + f * (4 - 3 * ca2))
    cm = np.cos(2 * sigma1 + sigma)
    ell = lam - (1 - c) * f * sa * (sigma + c * np.sin(sigma) * (cm + c * np.cos(sigma) * (2 * cm * cm - 1)))
    return np.asarray(lon, float) + np.degrees(ell), np.degrees(lat2)


@F.pandas_udf(T.DoubleType())
def ellipsoid_distance(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.Series:
    return pd.Series(ellipsoid_inverse(lon1, lat1, lon2, lat2)[0])


def _units(lon, lat) -> np.ndarray:
    a, b = np.broadcast_arrays(np.radians(np.asarray(lon, float)), np.radians(np.asarray(lat, float)))
    return np.stack([np.cos(b) * np.cos(a), np.cos(b) * np.sin(a), np.sin(b)], axis=-1)


def _inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(axis=-1)


def _normed(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length one, and which have a length at all (the others stay)."""
    size = np.sqrt(_inner(v, v))
    some = size > 1e-15
    return v / np.where(some, size, 1.0)[..., None], some


def _inside(a: np.ndarray, x: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (_inner(np.cross(a, x), n) >= 0) & (_inner(np.cross(x, b), n) >= 0)


def project_on_arcs(lon, lat, lon1, lat1, lon2, lat2) -> tuple[np.ndarray, np.ndarray]:
    """The points of great arcs nearest to points: their feet, or the nearer ends."""
    lon, lat, lon1, lat1, lon2, lat2 = np.broadcast_arrays(*(np.asarray(x, float) for x in (lon, lat, lon1, lat1, lon2, lat2)))
    p, a, b = _units(lon, lat), _units(lon1, lat1), _units(lon2, lat2)
    n, arc = _normed(np.cross(a, b))
    foot, some = _normed(p - _inner(p, n)[..., None] * n)
    on = arc & some & _inside(a, foot, b, n)
    first = ~arc | (_inner(p, a) >= _inner(p, b))
    x, y = np.degrees(np.arctan2(foot[..., 1], foot[..., 0])), np.degrees(np.arcsin(np.clip(foot[..., 2], -1, 1)))
    return np.where(on, x, np.where(first, lon1, lon2)), np.where(on, y, np.where(first, lat1, lat2))


def project_on_arc(lon: float, lat: float, lon1: float, lat1: float, lon2: float, lat2: float) -> tuple[float, float]:
    x, y = project_on_arcs(lon, lat, lon1, lat1, lon2, lat2)
    return float(x), float(y)


def turn_offsets(px, py, heading_p, qx, qy, heading_q) -> tuple[np.ndarray, np.ndarray]:
    """Where the lines through plane points along their headings meet; NaN where parallel."""

    def line(x, y, h) -> np.ndarray:
        x, y, h = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, y, h)))
        one = np.ones_like(x)
        return np.cross(np.stack([x, y, one], axis=-1), np.stack([x + np.sin(np.radians(h)), y + np.cos(np.radians(h)), one], axis=-1))

    m = np.cross(line(px, py, heading_p), line(qx, qy, heading_q))
    w = np.where(np.abs(m[..., 2]) < 1e-12, np.nan, m[..., 2])
    return m[..., 0] / w, m[..., 1] / w


def turn_offset(p: tuple[float, float], heading_p: float, q: tuple[float, float], heading_q: float) -> tuple[float, float] | None:
    x, y = turn_offsets(*p, heading_p, *q, heading_q)
    return None if np.isnan(x) else (float(x), float(y))


def arc_envelopes(lon, lat) -> tuple[np.ndarray, np.ndarray]:
    """Least boxes around great arcs on the unit sphere: ends, and extremes inside the arcs.

    The last axis of ``lon`` and ``lat`` runs along the points of a line of arcs.
    """
    units = _units(lon, lat)
    low, high = units.min(axis=-2), units.max(axis=-2)
    for k in range(units.shape[-2] - 1):
        a, b = units[..., k, :], units[..., k + 1, :]
        n, arc = _normed(np.cross(a, b))
        for axis in np.eye(3):
            top, some = _normed(axis - _inner(axis, n)[..., None] * n)
            for t in (top, -top):
                on = (arc & some & _inside(a, t, b, n))[..., None]
                low, high = np.where(on, np.minimum(low, t), low), np.where(on, np.maximum(high, t), high)
    return low, high


def arc_envelope(points: list[tuple[float, float]]) -> tuple[np.ndarray, np.ndarray]:
    lon, lat = zip(*points, strict=True)
    return arc_envelopes(lon, lat)


# -- trails, envelopes, well-known text


def project_on_segment(p: tuple[Column, Column], a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    """The point of a planar segment nearest to ``p``."""
    d = (b[0] - a[0], b[1] - a[1])
    along = F.coalesce(F.try_divide((p[0] - a[0]) * d[0] + (p[1] - a[1]) * d[1], d[0] * d[0] + d[1] * d[1]), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    return a[0] + t * d[0], a[1] + t * d[1]


def project_on_trail(x: Column, y: Column, trail: Column) -> Column:
    """``distance, x, y`` of the point of a planar polyline (array of x, y) nearest to a point;
    null if it has no point.  Of equally near ones the one with the smaller coordinates."""
    ends = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(trail) - 2)), lambda i: F.struct(F.get(trail, i).alias("a"), F.coalesce(F.get(trail, i + 1), F.get(trail, i)).alias("b")))

    def near(s: Column) -> Column:
        px, py = project_on_segment((x, y), (s["a"]["x"], s["a"]["y"]), (s["b"]["x"], s["b"]["y"]))
        return F.struct(F.hypot(x - px, y - py).alias("distance"), px.alias("x"), py.alias("y"))

    return F.when(F.size(trail) > 0, F.array_min(F.transform(ends, near)))


def trail_distance(lon: Column, lat: Column, trail: Column) -> Column:
    """Metres from a point to a polyline (array of lon, lat) on the sphere; null without a point.

    Each arc is taken in the plane that touches the sphere at the point, so arcs should be
    short against the radius.
    """
    scale = F.cos(F.radians(lat))
    flat = F.transform(trail, lambda q: F.struct((F.radians(q["lon"] - lon) * scale).alias("x"), F.radians(q["lat"] - lat).alias("y")))
    return project_on_trail(F.lit(0.0), F.lit(0.0), flat)["distance"] * RADIUS


def envelope_of(points: Column) -> Column:
    """``low, high`` of an array of coordinate arrays; null if it is empty or their lengths differ."""
    first = F.get(points, 0)
    fits = (F.size(points) > 0) & F.forall(points, lambda p: F.size(p) == F.size(first))
    bound = lambda f: F.aggregate(points, first, lambda a, p: F.zip_with(a, p, f))
    return F.when(fits, F.struct(bound(lambda x, y: F.least(x, y)).alias("low"), bound(lambda x, y: F.greatest(x, y)).alias("high")))


def envelope_include(e: Column, point: Column) -> Column:
    """An envelope grown to hold a point; null if their dimensions differ."""
    return F.when(F.size(e["low"]) == F.size(point), F.struct(F.zip_with(e["low"], point, lambda x, y: F.least(x, y)).alias("low"), F.zip_with(e["high"], point, lambda x, y: F.greatest(x, y)).alias("high")))


def envelope_expand(e: Column, by: Column) -> Column:
    """An envelope grown by a length on every side; null if nothing would be left."""
    grown = F.struct(F.transform(e["low"], lambda x: x - by).alias("low"), F.transform(e["high"], lambda x: x + by).alias("high"))
    return F.when(F.forall(F.zip_with(grown["low"], grown["high"], lambda a, b: a <= b), lambda x: x), grown)


def envelope_contains(e: Column, point: Column) -> Column:
    inside = lambda a, b: F.forall(F.zip_with(a, b, lambda x, y: x <= y), lambda x: x)
    return (F.size(e["low"]) == F.size(point)) & inside(e["low"], point) & inside(point, e["high"])


def parse_wkt_point(text: Column) -> Column:
    """``lon, lat`` of a POINT in well-known text, with or without a reference system before it."""
    part = lambda i: F.regexp_extract(text, r"(?i)^\s*(?:<[^>]*>\s*)?POINT\s*\(\s*(-?[\d.]+(?:e-?\d+)?)\s+(-?[\d.]+(?:e-?\d+)?)\s*\)\s*$", i).try_cast("double")
    return F.when(part(1).isNotNull() & part(2).isNotNull(), F.struct(part(1).alias("lon"), part(2).alias("lat")))


def wkt_distance(a: Column, b: Column) -> Column:
    """Metres between two points in well-known text, null for anything else."""
    p, q = parse_wkt_point(a), parse_wkt_point(b)
    return haversine(p["lon"], p["lat"], q["lon"], q["lat"])
