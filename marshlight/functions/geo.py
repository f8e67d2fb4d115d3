"""Polygon maths as higher-order functions. Polygons are array<array<array<struct<lon,lat>>>>: polygons, rings, points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marshlight.functions import constants as K
from marshlight.functions.text import let

POLYGONS = "array<array<array<struct<lon:double,lat:double>>>>"


def _sum_edges(ring: Column, edge) -> Column:  # noqa: ANN001
    """Sum of a function of neighbouring points, in ring order, so the result doesn't depend on partitioning."""

    def total(r: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(r) - 2, F.lit(0))), F.lit(0.0), lambda acc, i: acc + F.coalesce(edge(F.get(r, i), F.get(r, i + 1)), F.lit(0.0)))

    return let(ring, total)


def parse_coordinates(text: Column) -> Column:
    """ "lon,lat[,alt] ..." to points; blanks round commas are allowed, bad tuples and altitudes are dropped."""
    joined = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s*,\s*", ",")
    parts = F.transform(F.split(F.trim(F.regexp_replace(joined, r"(?U)\s+", " ")), " "), lambda t: F.split(t, ","))
    points = F.transform(parts, lambda p: F.struct(F.get(p, 0).try_cast("double").alias("lon"), F.get(p, 1).try_cast("double").alias("lat")))
    return F.filter(points, lambda p: p["lon"].isNotNull() & p["lat"].isNotNull())


def close_ring(ring: Column) -> Column:
    is_open = lambda r: (F.size(r) >= 3) & (F.get(r, 0) != F.get(r, F.size(r) - 1))
    return let(ring, lambda r: F.when(is_open(r), F.concat(r, F.slice(r, 1, 1))).otherwise(r))


def signed_area(ring: Column) -> Column:
    """Planar, positive when counter-clockwise; only its sign is used."""
    return -_sum_edges(ring, lambda a, b: (b["lon"] - a["lon"]) * (b["lat"] + a["lat"])) / 2


def orient(ring: Column, counter_clockwise: bool) -> Column:
    return let(ring, lambda r: F.when((signed_area(r) >= 0) == F.lit(counter_clockwise), r).otherwise(F.reverse(r)))


def ring_area_sq_km(ring: Column) -> Column:
    """Absolute area of a closed ring on the sphere of the mean earth radius; 0 under four points."""
    edges = _sum_edges(ring, lambda a, b: F.radians(b["lon"] - a["lon"]) * (2 + F.sin(F.radians(a["lat"])) + F.sin(F.radians(b["lat"]))))
    return F.when(F.size(ring) < 4, 0.0).otherwise(F.abs(edges * K.EARTH_RADIUS_KM * K.EARTH_RADIUS_KM / 2))


def area_sq_km(polygons: Column) -> Column:
    """Exteriors less holes, at least 0 for each polygon, summed and rounded to 4 places."""

    def one(polygon: Column) -> Column:
        holes = F.slice(polygon, 2, F.greatest(F.size(polygon) - 1, F.lit(0)))
        return F.greatest(F.aggregate(holes, ring_area_sq_km(F.get(polygon, 0)), lambda acc, hole: acc - ring_area_sq_km(hole)), F.lit(0.0))

    return F.round(F.aggregate(F.transform(polygons, one), F.lit(0.0), lambda acc, a: acc + a), 4)


def centroid(polygons: Column) -> Column:
    """struct(lat, lon) of the first polygon's exterior; of a degenerate ring the mean of its points; rounded to 6 places."""
    ring = F.get(F.get(polygons, 0), 0)
    cross = lambda a, b: a["lon"] * b["lat"] - b["lon"] * a["lat"]
    double_area = _sum_edges(ring, cross)
    x = _sum_edges(ring, lambda a, b: (a["lon"] + b["lon"]) * cross(a, b))
    y = _sum_edges(ring, lambda a, b: (a["lat"] + b["lat"]) * cross(a, b))
    flat = F.abs(double_area) < 1e-12
    mean = lambda k: F.try_divide(F.aggregate(ring, F.lit(0.0), lambda acc, p: acc + p[k]), F.size(ring))
    pick = lambda k, total: F.round(F.when(flat, mean(k)).otherwise(F.try_divide(total, 3 * double_area)), 6)
    return F.when(F.size(ring) > 0, F.struct(pick("lat", y).alias("lat"), pick("lon", x).alias("lon")))


def rings(polygons: Column) -> Column:
    return F.flatten(polygons)


def points(polygons: Column) -> Column:
    return F.flatten(F.flatten(polygons))


def bbox(polygons: Column) -> Column:
    """struct(min_lon, min_lat, max_lon, max_lat) over all rings, holes too."""
    lon, lat = F.transform(points(polygons), lambda p: p["lon"]), F.transform(points(polygons), lambda p: p["lat"])
    return F.struct(F.array_min(lon).alias("min_lon"), F.array_min(lat).alias("min_lat"), F.array_max(lon).alias("max_lon"), F.array_max(lat).alias("max_lat"))


def in_bounds(point: Column) -> Column:
    return point["lon"].between(*K.LON_RANGE) & point["lat"].between(*K.LAT_RANGE)


def out_of_bounds(polygons: Column) -> Column:
    """True if a point lies outside the area, or if there are no points."""
    return (F.coalesce(F.size(points(polygons)), F.lit(0)) <= 0) | F.exists(points(polygons), lambda p: ~in_bounds(p))


def geometry_type(polygons: Column) -> Column:
    return F.when(F.size(polygons) == 1, "Polygon").when(F.size(polygons) > 1, "MultiPolygon")


def build_polygons(raw: Column) -> Column:
    """From array<struct<outer string, inners array<string>>> of coordinate texts: closed and oriented rings.

    An exterior under four points drops its polygon, a hole under four points only itself.
    """

    def one(p: Column) -> Column:
        outer = orient(close_ring(parse_coordinates(p["outer"])), True)  # each step is evaluated once
        holes = F.filter(F.transform(p["inners"], lambda t: close_ring(parse_coordinates(t))), lambda r: F.size(r) >= 4)
        return F.concat(F.array(outer), F.transform(holes, lambda r: orient(r, False)))

    return F.filter(F.transform(raw, one), lambda p: F.size(F.get(p, 0)) >= 4)


def geojson_coordinates(polygons: Column) -> Column:
    """The coordinates member as JSON text: one polygon's rings, or all polygons."""
    pairs = F.transform(polygons, lambda poly: F.transform(poly, lambda ring: F.transform(ring, lambda p: F.array(p["lon"], p["lat"]))))
    return F.when(F.size(polygons) == 1, F.to_json(F.get(pairs, 0))).otherwise(F.to_json(pairs))
