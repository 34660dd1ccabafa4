"""Coordinate Columns: projections, distances, similarity maps."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits and sizes of the web map and of the earth that results depend on.
MAX_LATITUDE, CIRCUMFERENCE = 85.05112878, 40075016.68557849
METRES_PER_LNG, METRES_PER_LAT = 111320.0, 110540.0
RADIUS, RADIUS_ROUND = 6371008.8, 6371000.0


def web_mercator(lat: Column, lng: Column) -> tuple[Column, Column]:
    """Metres (x, y) on the web map; latitudes are clamped."""
    s = F.sin(F.radians(F.greatest(F.lit(-MAX_LATITUDE), F.least(F.lit(MAX_LATITUDE), lat))))
    half = CIRCUMFERENCE / 2
    return lng / 180 * half, F.log((1 + s) / (1 - s)) / (4 * math.pi) * CIRCUMFERENCE


def web_mercator_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    """Latitude and longitude of web-map metres."""
    return F.degrees(F.atan(F.sinh(y * (2 * math.pi / CIRCUMFERENCE)))), x / (CIRCUMFERENCE / 2) * 180


def similarity(x: Column, y: Column, a: float, b: float, tx: float, ty: float) -> tuple[Column, Column]:
    """Rotation and scale (a, b), then shift."""
    return a * x - b * y + tx, b * x + a * y + ty


def similarity_inverse(x: Column, y: Column, a: float, b: float, tx: float, ty: float) -> tuple[Column, Column]:
    n = a * a + b * b
    return (a * (x - tx) + b * (y - ty)) / n, (a * (y - ty) - b * (x - tx)) / n


def local_xy(lat: Column, lng: Column, lat0, lng0) -> tuple[Column, Column]:
    """Equirectangular metres around a reference point."""
    lat0, lng0 = F.lit(lat0), F.lit(lng0)
    return (lng - lng0) * METRES_PER_LNG * F.cos(F.radians(lat0)), (lat - lat0) * METRES_PER_LAT


def local_ll(x: Column, y: Column, lat0, lng0) -> tuple[Column, Column]:
    lat0, lng0 = F.lit(lat0), F.lit(lng0)
    return y / METRES_PER_LAT + lat0, x / (METRES_PER_LNG * F.cos(F.radians(lat0))) + lng0


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column, radius: float = RADIUS) -> Column:
    """Great-circle metres."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def mean_latitude_distance(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres on a plane with METRES_PER_LNG for each degree, longitudes narrowed at the mean latitude."""
    east = (lng1 - lng2) * METRES_PER_LNG * F.cos(F.radians((lat1 + lat2) * 0.5))
    return F.hypot(east, (lat1 - lat2) * METRES_PER_LNG)


def two_point_similarity(x: Column, y: Column, src: tuple, dst: tuple) -> tuple[Column, Column]:
    """The similarity that takes two source points to two targets; both pairs as ((x, y), (x, y))."""
    (ax, ay), (bx, by) = src
    (cx, cy), (dx, dy) = dst
    ux, uy, vx, vy = bx - ax, by - ay, dx - cx, dy - cy
    n = ux * ux + uy * uy
    a, b = (ux * vx + uy * vy) / n, (ux * vy - uy * vx) / n
    return similarity(x - ax, y - ay, a, b, cx, cy)


def near_map_edge(lat: Column, lng: Column, south: float, north: float, west: float, east: float, d_lat: float = 0.00022, d_lng: float = 0.00032) -> Column:
    """Within the margins of the bounds' sides."""
    return (lat - south < d_lat) | (north - lat < d_lat) | (lng - west < d_lng) | (east - lng < d_lng)


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column]:
    """Distance of a point to a segment, and where along it (0..1) the nearest point lies."""
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    t = F.when(n == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - ax) * dx + (py - ay) * dy) / n)))
    return F.sqrt(F.pow(px - ax - t * dx, 2) + F.pow(py - ay - t * dy, 2)), t


def segments_cross(ax, ay, bx, by, cx, cy, dx, dy, eps: float = 1e-9) -> Column:
    """Whether two closed segments meet, collinear overlap included."""
    turn = lambda ox, oy, px, py, qx, qy: (px - ox) * (qy - oy) - (py - oy) * (qx - ox)
    on = lambda ox, oy, px, py, qx, qy: (qx >= F.least(ox, px) - eps) & (qx <= F.greatest(ox, px) + eps) & (qy >= F.least(oy, py) - eps) & (qy <= F.greatest(oy, py) + eps)
    t1, t2 = turn(ax, ay, bx, by, cx, cy), turn(ax, ay, bx, by, dx, dy)
    t3, t4 = turn(cx, cy, dx, dy, ax, ay), turn(cx, cy, dx, dy, bx, by)
    proper = (((t1 > eps) & (t2 < -eps)) | ((t1 < -eps) & (t2 > eps))) & (((t3 > eps) & (t4 < -eps)) | ((t3 < -eps) & (t4 > eps)))
    touch = ((F.abs(t1) <= eps) & on(ax, ay, bx, by, cx, cy)) | ((F.abs(t2) <= eps) & on(ax, ay, bx, by, dx, dy)) | ((F.abs(t3) <= eps) & on(cx, cy, dx, dy, ax, ay)) | ((F.abs(t4) <= eps) & on(cx, cy, dx, dy, bx, by))
    return proper | touch
