"""Geometry as Column expressions over lon and lat doubles and arrays of struct<x,y>."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius of the earth in metres; a sphere is up to half a per cent off the spheroid.
EARTH = 6371008.8


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between two points."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def _edges(ring: list[tuple[float, float]]) -> list[tuple[tuple[float, float], tuple[float, float]]]:
    closed = ring if ring[0] == ring[-1] else [*ring, ring[0]]
    return list(zip(closed, closed[1:], strict=False))


def on_ring(lon: Column, lat: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether the point lies on an edge."""
    out = F.lit(False)
    for (x1, y1), (x2, y2) in _edges(ring):
        cross = (lon - x1) * (y2 - y1) - (lat - y1) * (x2 - x1)
        out = out | ((F.abs(cross) < 1e-12) & lon.between(min(x1, x2), max(x1, x2)) & lat.between(min(y1, y2), max(y1, y2)))
    return out


def _crossings(lon: Column, lat: Column, ring: list[tuple[float, float]]) -> Column:
    n = F.lit(0)
    for (x1, y1), (x2, y2) in _edges(ring):
        if y1 != y2:
            n = n + F.when(((lat < y1) != (lat < y2)) & (lon < (lat - y1) * ((x2 - x1) / (y2 - y1)) + x1), 1).otherwise(0)
    return n % 2 == 1


def in_box(lon: Column, lat: Column, rings: list[list[tuple[float, float]]]) -> Column:
    xs, ys = zip(*(p for r in rings for p in r), strict=True)
    return lon.between(min(xs), max(xs)) & lat.between(min(ys), max(ys))


def contains(lon: Column, lat: Column, rings: list[list[tuple[float, float]]]) -> Column:
    """Strictly inside the first ring and outside of the others; the edge is outside."""
    inside = _crossings(lon, lat, rings[0]) & ~on_ring(lon, lat, rings[0])
    for hole in rings[1:]:
        inside = inside & ~_crossings(lon, lat, hole) & ~on_ring(lon, lat, hole)
    return in_box(lon, lat, rings) & inside


def intersects(lon: Column, lat: Column, rings: list[list[tuple[float, float]]]) -> Column:
    """Inside, or on an edge."""
    edge = F.lit(False)
    for ring in rings:
        edge = edge | on_ring(lon, lat, ring)
    return in_box(lon, lat, rings) & (contains(lon, lat, rings) | edge)


def half_open(lon: Column, lat: Column, rings: list[list[tuple[float, float]]]) -> Column:
    """Inside by the number of edges crossed; of the edges those to the left and below count, so that areas that share an edge never share a point."""
    return in_box(lon, lat, rings) & reduce(lambda a, b: a != b, (_crossings(lon, lat, r) for r in rings))


def distance_to_line(lon: Column, lat: Column, line: list[tuple[float, float]]) -> Column:
    """Metres to the nearest segment, in a plane around the line's mean latitude."""
    ky = math.pi / 180 * EARTH
    kx = ky * math.cos(math.radians(sum(y for _, y in line) / len(line)))
    out = []
    for (x1, y1), (x2, y2) in zip(line, line[1:], strict=False):
        dx, dy = (x2 - x1) * kx, (y2 - y1) * ky
        px, py = (lon - x1) * kx, (lat - y1) * ky
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (px * dx + py * dy) / ((dx * dx + dy * dy) or 1.0)))
        out.append(F.sqrt(F.pow(px - t * dx, 2) + F.pow(py - t * dy, 2)))
    return F.least(*out) if len(out) > 1 else out[0]


def cell(lon: Column, lat: Column, size: float) -> Column:
    """The grid cell of a point, as a long."""
    return (F.floor(lon / size) * 1_000_003 + F.floor(lat / size)).cast("long")


#: Width of the smallest cubes, in metres; a distance of 0 has them as well.
LEAST_CUBE = 0.001


def _cube(lon: Column, lat: Column, metres: float) -> list[Column]:
    """The cube of space, `metres` wide as the crow flies through the earth, in which a point of the sphere lies."""
    if metres < 0:
        raise ValueError(f"a distance of {metres} m")
    width = max(2 * EARTH * math.sin(min(metres / (2 * EARTH), math.pi / 2)) * 1.0000001, LEAST_CUBE)
    around = F.cos(F.radians(lat)) * EARTH
    return [F.floor(x / width) for x in (around * F.cos(F.radians(lon)), around * F.sin(F.radians(lon)), F.sin(F.radians(lat)) * EARTH)]


def space_cell(lon: Column, lat: Column, metres: float) -> Column:
    """The cube of a point as a long. Cubes know no date line and no poles."""
    return F.xxhash64(*_cube(lon, lat, metres))


def near_space_cells(lon: Column, lat: Column, metres: float) -> Column:
    """The cube of a point and its neighbours; every point at most `metres` away along the sphere lies in one of them."""
    steps = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
    cube = _cube(lon, lat, metres)
    return F.array_distinct(F.array(*(F.xxhash64(*(c + d for c, d in zip(cube, step, strict=True))) for step in steps)))


def vertex_mean(points: Column) -> Column:
    """Mean of all vertices, a closing one included."""
    n = F.size(points)
    total = F.aggregate(points, F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), lambda a, p: F.struct((a.x + p.x).alias("x"), (a.y + p.y).alias("y")))
    return F.when(n > 0, F.struct((total.x / n).alias("x"), (total.y / n).alias("y")))


def _pairs(ring: Column) -> Column:
    return F.zip_with(ring, F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def ring_area(ring: Column) -> Column:
    """Signed planar area (shoelace)."""
    return F.aggregate(_pairs(ring), F.lit(0.0), lambda s, e: s + e.a.x * e.b.y - e.b.x * e.a.y) / 2


def centroid(ring: Column) -> Column:
    """Area-weighted centroid of a ring; the vertex mean where it has no area."""
    area = ring_area(ring)
    cross = lambda e: e.a.x * e.b.y - e.b.x * e.a.y
    x = F.aggregate(_pairs(ring), F.lit(0.0), lambda s, e: s + (e.a.x + e.b.x) * cross(e)) / (6 * area)
    y = F.aggregate(_pairs(ring), F.lit(0.0), lambda s, e: s + (e.a.y + e.b.y) * cross(e)) / (6 * area)
    return F.when(F.abs(area) > 0, F.struct(x.alias("x"), y.alias("y"))).otherwise(vertex_mean(ring))


def decode_polyline(text: Column, precision: int = 6) -> Column:
    """Points of an encoded polyline: five bits a character, deltas of lat and lon."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c) - 63)
    start = F.struct(F.lit(0).cast("long").alias("v"), F.lit(1).cast("long").alias("unit"), F.array().cast("array<bigint>").alias("out"))

    def step(s, c):
        v = s.v + c.bitwiseAND(31).cast("long") * s.unit
        signed = F.when(v % 2 == 1, -F.shiftright(v, 1) - 1).otherwise(F.shiftright(v, 1))
        more = c >= 32
        return F.struct(F.when(more, v).otherwise(F.lit(0).cast("long")).alias("v"), F.when(more, s.unit * 32).otherwise(F.lit(1).cast("long")).alias("unit"), F.when(more, s.out).otherwise(F.array_append(s.out, signed)).alias("out"))

    deltas = F.aggregate(codes, start, step, lambda s: s.out)
    at = F.struct(F.lit(0).cast("long").alias("y"), F.lit(0).cast("long").alias("x"), F.array().cast("array<struct<x:double,y:double>>").alias("out"))
    scale = float(10**precision)

    def point(s, i):
        y, x = s.y + F.get(deltas, 2 * i), s.x + F.get(deltas, 2 * i + 1)
        return F.struct(y.alias("y"), x.alias("x"), F.array_append(s.out, F.struct((x / scale).alias("x"), (y / scale).alias("y"))).alias("out"))

    n = F.floor(F.size(deltas) / 2).cast("int")
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), at, point, lambda s: s.out)).otherwise(F.array().cast("array<struct<x:double,y:double>>"))


def edges(ring: Column) -> Column:
    """struct(a, b) of the edges of a ring (array of struct<x,y>), closed or not."""
    return _pairs(ring)


def _crosses(lon: Column, lat: Column, ring: Column) -> Column:
    over = lambda e: ((lat < e.a.y) != (lat < e.b.y)) & (lon < (lat - e.a.y) * ((e.b.x - e.a.x) / F.nullif(e.b.y - e.a.y, F.lit(0.0))) + e.a.x)
    return F.size(F.filter(edges(ring), over)) % 2 == 1


def on_edge(lon: Column, lat: Column, ring: Column) -> Column:
    """Whether the point lies on an edge of the ring."""
    return F.exists(edges(ring), lambda e: (F.abs((lon - e.a.x) * (e.b.y - e.a.y) - (lat - e.a.y) * (e.b.x - e.a.x)) < 1e-12)
        & lon.between(F.least(e.a.x, e.b.x), F.greatest(e.a.x, e.b.x)) & lat.between(F.least(e.a.y, e.b.y), F.greatest(e.a.y, e.b.y)))


def within_rings(lon: Column, lat: Column, rings: Column) -> Column:
    """Strictly inside the first ring and outside of the others, for rings that are a column; edges are outside."""
    hole = lambda r: _crosses(lon, lat, r) | on_edge(lon, lat, r)
    shell = F.get(rings, 0)
    return F.coalesce(_crosses(lon, lat, shell) & ~on_edge(lon, lat, shell) & ~F.exists(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(1))), hole), F.lit(False))


def meets_rings(lon: Column, lat: Column, rings: Column) -> Column:
    """Inside, or on an edge of any ring."""
    return within_rings(lon, lat, rings) | F.coalesce(F.exists(rings, lambda r: on_edge(lon, lat, r)), F.lit(False))


def _side(a: Column, b: Column, p: Column) -> Column:
    return F.signum((b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x))


def segments_meet(e: Column, f: Column) -> Column:
    """Whether two edges have a point in common."""
    within = lambda a, b, p: p.x.between(F.least(a.x, b.x), F.greatest(a.x, b.x)) & p.y.between(F.least(a.y, b.y), F.greatest(a.y, b.y))
    s1, s2, s3, s4 = _side(e.a, e.b, f.a), _side(e.a, e.b, f.b), _side(f.a, f.b, e.a), _side(f.a, f.b, e.b)
    touch = ((s1 == 0) & within(e.a, e.b, f.a)) | ((s2 == 0) & within(e.a, e.b, f.b)) | ((s3 == 0) & within(f.a, f.b, e.a)) | ((s4 == 0) & within(f.a, f.b, e.b))
    return ((s1 * s2 < 0) & (s3 * s4 < 0)) | touch


def rings_meet(a: Column, b: Column) -> Column:
    """Whether two polygons have a point in common: edges meet, or one lies in the other."""
    edges_of = lambda rings: F.flatten(F.transform(rings, edges))
    cross = F.exists(edges_of(a), lambda e: F.exists(edges_of(b), lambda f: segments_meet(e, f)))
    first = lambda rings: F.get(F.get(rings, 0), 0)
    return cross | within_rings(first(a).x, first(a).y, b) | within_rings(first(b).x, first(b).y, a)


def self_crossing(ring: Column) -> Column:
    """Whether two edges of a closed ring that are no neighbours have a point in common."""
    n = F.size(ring) - 1
    numbered = F.transform(F.slice(edges(ring), 1, F.greatest(n, F.lit(1))), lambda e, i: F.struct(e.a.alias("a"), e.b.alias("b"), i.alias("i")))
    apart = lambda e, f: (f.i > e.i + 1) & ~((e.i == 0) & (f.i == n - 1))
    return (n > 3) & F.exists(numbered, lambda e: F.exists(numbered, lambda f: apart(e, f) & segments_meet(e, f)))


def from_utm(east: Column, north: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Lon and lat of UTM metres on WGS84, by Krueger's series to the third order, good to millimetres within a zone."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64) * 0.9996
    beta = (n / 2 - 2 / 3 * n**2 + 37 / 96 * n**3, n**2 / 48 + n**3 / 15, 17 / 480 * n**3)
    delta = (2 * n - 2 / 3 * n**2 - 2 * n**3, 7 / 3 * n**2 - 8 / 5 * n**3, 56 / 15 * n**3)
    xi, eta = (north - F.when(south, 10_000_000.0).otherwise(0.0)) / radius, (east - 500_000.0) / radius
    x = xi - sum(b * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, b in enumerate(beta))
    e = eta - sum(b * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, b in enumerate(beta))
    chi = F.asin(F.sin(x) / F.cosh(e))
    lat = chi + sum(d * F.sin(2 * (j + 1) * chi) for j, d in enumerate(delta))
    return zone * 6.0 - 183.0 + F.degrees(F.atan2(F.sinh(e), F.cos(x))), F.degrees(lat)


def to_utm(lon: Column, lat: Column, zone: int) -> tuple[Column, Column]:
    """East and north in metres of UTM on WGS84, for the northern half, by the same series."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64) * 0.9996
    alpha = (n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3, 13 / 48 * n**2 - 3 / 5 * n**3, 61 / 240 * n**3)
    e = 2 * math.sqrt(n) / (1 + n)
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    d = F.radians(lon - (zone * 6.0 - 183.0))
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    x = xi + sum(c * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, c in enumerate(alpha))
    y = eta + sum(c * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, c in enumerate(alpha))
    return 500_000.0 + radius * y, radius * x
