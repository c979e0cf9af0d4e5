"""Geodesy as Column expressions (spherical earth); no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EARTH_KM = 6371.0
KM_PER_NM = 1.852
KM_PER_DEGREE = 111.0


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def haversine_km(lat1, lon1, lat2, lon2, radius: float = EARTH_KM) -> Column:
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2.0 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def point_in_bbox(lat: Column, lon: Column, min_lat, min_lon, max_lat, max_lon) -> Column:
    return lat.between(_c(min_lat), _c(max_lat)) & lon.between(_c(min_lon), _c(max_lon))


def point_in_radius(lat: Column, lon: Column, lat0: float, lon0: float, radius_km: float) -> Column:
    """Box conjuncts first (they reach the scan), then the exact distance.

    The box's longitude is widened by the latitude and left out where it would reach a
    pole or wrap past 180 degrees.
    """
    import math

    pad = radius_km / KM_PER_DEGREE * 1.01
    box = lat.between(lat0 - pad, lat0 + pad)
    top = abs(lat0) + pad
    if top < 89:
        wide = pad / math.cos(math.radians(top))
        if -180 <= lon0 - wide and lon0 + wide <= 180:
            box = box & lon.between(lon0 - wide, lon0 + wide)
    return box & (haversine_km(lat, lon, lat0, lon0) <= radius_km)


def bearing(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    dl = F.radians(lon2 - lon1)
    y = F.sin(dl) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(dl)
    return (F.degrees(F.atan2(y, x)) + 360.0) % 360.0


def destination(lat, lon, bearing_deg, distance_km) -> tuple[Column, Column]:
    lat, lon, b, d = _c(lat), _c(lon), F.radians(_c(bearing_deg)), _c(distance_km) / EARTH_KM
    la = F.radians(lat)
    lat2 = F.asin(F.sin(la) * F.cos(d) + F.cos(la) * F.sin(d) * F.cos(b))
    lon2 = F.radians(lon) + F.atan2(F.sin(b) * F.sin(d) * F.cos(la), F.cos(d) - F.sin(la) * F.sin(lat2))
    return F.degrees(lat2), F.degrees(lon2)


def project_position(lat, lon, speed_knots, course_deg, minutes) -> tuple[Column, Column]:
    return destination(lat, lon, course_deg, _c(speed_knots) * KM_PER_NM * _c(minutes) / 60.0)


def heading_diff(a, b) -> Column:
    d = F.abs(_c(a) - _c(b)) % 360.0
    return F.least(d, 360.0 - d)


def point_in_polygon(lat: Column, lon: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd rule over a fixed ring of (lat, lon), unrolled into one expression; fewer than three corners hold nothing."""
    if len(ring) < 3:
        return F.lit(False)
    crossings = F.lit(0)
    for (y1, x1), (y2, x2) in zip(ring, ring[1:] + ring[:1]):
        if y1 == y2:
            continue
        spans = (F.lit(y1) > lat) != (F.lit(y2) > lat)
        crossings = crossings + F.when(spans & (lon < F.lit(x1) + (lat - y1) * F.lit((x2 - x1) / (y2 - y1))), 1).otherwise(0)
    return (crossings % 2) == 1


def parse_wkt_polygon(text: str) -> list[tuple[float, float]]:
    """Outer ring of a WKT POLYGON (lon lat order) as (lat, lon)."""
    import re

    m = re.match(r"\s*POLYGON\s*\(\s*\(([^)]*)\)", text, re.I)
    if not m:
        raise ValueError(f"not a WKT polygon: {text[:60]!r}")
    ring = [tuple(map(float, p.split()[:2])) for p in m[1].split(",")]
    ring = [(lat, lon) for lon, lat in ring]
    return ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring
