"""Distances and polygons as column expressions; nothing leaves the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import SqlBindingError

# Mean earth radius in metres, origin of the local plane, domain of coordinates.
RADIUS = 6371008.771415059
ORIGIN = (-12.0464, -77.0428)
LATITUDES, LONGITUDES = (-12.30, -11.80), (-77.25, -76.75)

Point = tuple[float, float]


def checked(point: Point) -> Point:
    """The point, if it lies in the domain."""
    latitude, longitude = map(float, point)
    if not (LATITUDES[0] <= latitude <= LATITUDES[1] and LONGITUDES[0] <= longitude <= LONGITUDES[1]):
        raise SqlBindingError(f"point ({latitude}, {longitude}) lies outside the domain")
    return latitude, longitude


def haversine(latitude: Column, longitude: Column, point: Point) -> Column:
    p, q = F.radians(latitude), F.radians(longitude)
    p0, q0 = (F.radians(F.lit(float(x))) for x in point)
    a = F.pow(F.sin((p - p0) / 2), 2) + F.cos(p) * F.cos(p0) * F.pow(F.sin((q - q0) / 2), 2)
    return 2 * RADIUS * F.asin(F.sqrt(F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))))


def euclidean(latitude: Column, longitude: Column, point: Point) -> Column:
    """Distance in a plane tangent at the origin."""
    across = RADIUS * math.cos(math.radians(ORIGIN[0]))
    return F.hypot(across * F.radians(longitude - point[1]), RADIUS * F.radians(latitude - point[0]))


METRICS = {"haversine": haversine, "euclidean": euclidean}


def near(latitude: Column, longitude: Column, point: Point, radius: float, metric: str) -> Column:
    """A box of coordinates that holds all points within ``radius`` metres: a range that reaches the file scan."""
    slack = 1 + 1e-9
    up = math.degrees(radius / RADIUS) * slack + 1e-9
    if metric == "euclidean":
        side = up / math.cos(math.radians(ORIGIN[0])) * slack + 1e-9
    else:  # the widest longitude of a cap, see the tangent meridians of a circle on a sphere
        sine = math.sin(min(radius / RADIUS, math.pi / 2)) / max(math.cos(math.radians(point[0])), 1e-12)
        side = (math.degrees(math.asin(sine)) if sine < 1 else 180.0) * slack + 1e-9
    return latitude.between(point[0] - up, point[0] + up) & longitude.between(point[1] - side, point[1] + side)


def polygon(points: list[Point]) -> list[Point]:
    """Vertices of a simple polygon, without the closing one; refuses others."""
    ring = [tuple(map(float, p)) for p in points]
    ring = ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring
    if len(set(ring)) != len(ring) or len(ring) < 3:
        raise SqlBindingError("a polygon needs at least three different vertices")
    n = len(ring)
    area = sum(ring[i][1] * ring[(i + 1) % n][0] - ring[(i + 1) % n][1] * ring[i][0] for i in range(n))
    if abs(area) < 1e-18:
        raise SqlBindingError("a polygon needs an area")
    turn = lambda a, b, c: (b[1] - a[1]) * (c[0] - a[0]) - (b[0] - a[0]) * (c[1] - a[1])
    for i in range(n):
        for j in range(i + 2, n):
            if (j + 1) % n != i and turn(ring[i], ring[i + 1], ring[j]) * turn(ring[i], ring[i + 1], ring[(j + 1) % n]) <= 0 and turn(ring[j], ring[(j + 1) % n], ring[i]) * turn(ring[j], ring[(j + 1) % n], ring[i + 1]) <= 0:
                raise SqlBindingError("a polygon must not cross itself")
    return ring


def within(latitude: Column, longitude: Column, points: list[Point]) -> Column:
    """Inside the polygon or on its edge: crossings of a ray, an unrolled expression over the edges."""
    ring = polygon(points)
    lats, lons = [p[0] for p in ring], [p[1] for p in ring]
    on_edge, crossings = F.lit(False), F.lit(0)
    for (a_lat, a_lon), (b_lat, b_lon) in zip(ring, [*ring[1:], ring[0]], strict=True):
        cross = (longitude - a_lon) * (b_lat - a_lat) - (latitude - a_lat) * (b_lon - a_lon)
        # Coordinates carry a rounding of 2 ** -52 of their size; so does the edge's length times that.
        tolerance = 4 * 2.0**-52 * max(abs(a_lat), abs(b_lat), abs(a_lon), abs(b_lon)) * (abs(b_lat - a_lat) + abs(b_lon - a_lon))
        on_edge = on_edge | ((F.abs(cross) <= tolerance) & latitude.between(min(a_lat, b_lat), max(a_lat, b_lat)) & longitude.between(min(a_lon, b_lon), max(a_lon, b_lon)))
        if a_lat != b_lat:
            right = longitude < a_lon + (latitude - a_lat) * ((b_lon - a_lon) / (b_lat - a_lat))
            crossings = crossings + F.when(((latitude < a_lat) != (latitude < b_lat)) & right, 1).otherwise(0)
    box = latitude.between(min(lats), max(lats)) & longitude.between(min(lons), max(lons))
    return box & (on_edge | (crossings % 2 == 1))
