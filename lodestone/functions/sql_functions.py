"""Spatial functions for SQL, as temporary functions whose bodies are SQL expressions.

A point is a struct<x,y> of lon and lat, a polygon without holes an array of such, its first and last point the same or
not. A geometry of any kind is a struct<type,coordinates> with the coordinates as JSON text, as features have it.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from lodestone.functions.geo import EARTH
from lodestone.operators import repair

_POINT, _RING = "struct<x: double, y: double>", "array<struct<x: double, y: double>>"
_GEOMETRY = "struct<type: string, coordinates: string>"
_DISTANCE = f"2 * {EARTH} * asin(sqrt(least(1.0, pow(sin(radians(b.y - a.y) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin(radians(b.x - a.x) / 2), 2))))"
_AREA = "aggregate({0}, 0D, (s, e) -> s + e.p.x * e.q.y - e.q.x * e.p.y) / 2"


def _edges(ring: str) -> str:
    return f"zip_with({ring}, concat(slice({ring}, 2, size({ring})), slice({ring}, 1, 1)), (p, q) -> struct(p, q))"


def _crossed(edges: str) -> str:
    return f"size(filter({edges}, e -> (a.y < e.p.y) <> (a.y < e.q.y) and a.x < (a.y - e.p.y) * ((e.q.x - e.p.x) / nullif(e.q.y - e.p.y, 0)) + e.p.x)) % 2 = 1"


def _on_edge(edges: str) -> str:
    return f"exists({edges}, e -> abs((a.x - e.p.x) * (e.q.y - e.p.y) - (a.y - e.p.y) * (e.q.x - e.p.x)) < 1e-12 and a.x between least(e.p.x, e.q.x) and greatest(e.p.x, e.q.x) and a.y between least(e.p.y, e.q.y) and greatest(e.p.y, e.q.y))"


_EDGES = _edges("ring")
_CROSSED, _ON_EDGE = _crossed(_EDGES), _on_edge(_EDGES)
_ALL_EDGES = f"flatten(transform(flatten(st_rings(g)), r -> {_edges('r')}))"
_NUMBER = r"([-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?)"


def _read(depth: int) -> str:
    return f"from_json(g.coordinates, '{'array<' * depth}array<double>{'>' * depth}')"


def _points(line: str) -> str:
    return f"transform({line}, p -> named_struct('x', get(p, 0), 'y', get(p, 1)))"


# Polygons as lists of rings; a point or line is a polygon of one ring, so that all kinds have one form.
_RINGS = f"""case g.type when 'Point' then array(array({_points(f"array({_read(0)})")})) when 'MultiPoint' then array(array({_points(_read(1))})) when 'LineString' then array(array({_points(_read(1))}))
    when 'MultiLineString' then array(transform({_read(2)}, r -> {_points('r')})) when 'Polygon' then array(transform({_read(2)}, r -> {_points('r')})) when 'MultiPolygon' then transform({_read(3)}, m -> transform(m, r -> {_points('r')})) end"""
# Parts with a weight and a place each: rings by their area, holes against it, steps of lines by their length, points by one.
_STEPS = "flatten(transform(flatten(st_rings(g)), r -> zip_with(slice(r, 1, greatest(size(r) - 1, 0)), slice(r, 2, size(r)), (p, q) -> named_struct('w', sqrt(pow(q.x - p.x, 2) + pow(q.y - p.y, 2)), 'x', (p.x + q.x) / 2, 'y', (p.y + q.y) / 2))))"
_AREAS = f"""flatten(transform(st_rings(g), m -> transform(m, (r, i) -> transform(array({_edges('r')}), es -> transform(array({_AREA.format('es')}), o -> named_struct('w', if(i = 0, 1, -1) * abs(o),
    'x', aggregate(es, 0D, (s, e) -> s + (e.p.x + e.q.x) * (e.p.x * e.q.y - e.q.x * e.p.y)) / (6 * nullif(o, 0)), 'y', aggregate(es, 0D, (s, e) -> s + (e.p.y + e.q.y) * (e.p.x * e.q.y - e.q.x * e.p.y)) / (6 * nullif(o, 0))))[0])[0])))"""
_EVEN = "transform(filter(flatten(flatten(st_rings(g))), p -> p.x is not null), p -> named_struct('w', 1D, 'x', p.x, 'y', p.y))"
_MEAN = "transform(array(filter({0}, v -> v.w <> 0)), vs -> if(aggregate(vs, 0D, (s, v) -> s + v.w) <> 0, named_struct('x', aggregate(vs, 0D, (s, v) -> s + v.w * v.x) / aggregate(vs, 0D, (s, v) -> s + v.w), 'y', aggregate(vs, 0D, (s, v) -> s + v.w * v.y) / aggregate(vs, 0D, (s, v) -> s + v.w)), null))[0]"

#: Name, parameters, type and body of each function.
FUNCTIONS = (
    ("st_point", "lon double, lat double", _POINT, "if(lon is null or lat is null, null, named_struct('x', lon, 'y', lat))"),
    ("st_x", f"a {_POINT}", "double", "a.x"),
    ("st_y", f"a {_POINT}", "double", "a.y"),
    ("st_distance", f"a {_POINT}, b {_POINT}", "double", _DISTANCE),
    ("st_dwithin", f"a {_POINT}, b {_POINT}, metres double", "boolean", f"{_DISTANCE} <= metres"),
    ("st_makeenvelope", "minx double, miny double, maxx double, maxy double", _RING, "array(named_struct('x', minx, 'y', miny), named_struct('x', maxx, 'y', miny), named_struct('x', maxx, 'y', maxy), named_struct('x', minx, 'y', maxy))"),
    ("st_polygonfromtext", "wkt string", _RING, r"transform(split(regexp_extract(wkt, '(?i)^\\s*polygon\\s*\\(\\(([^()]*)\\)', 1), ','), p -> named_struct('x', double(split(trim(p), '\\s+')[0]), 'y', double(split(trim(p), '\\s+')[1])))"),
    ("st_within", f"a {_POINT}, ring {_RING}", "boolean", f"{_CROSSED} and not {_ON_EDGE}"),
    ("st_contains", f"ring {_RING}, a {_POINT}", "boolean", f"{_CROSSED} and not {_ON_EDGE}"),
    ("st_intersects", f"a {_POINT}, ring {_RING}", "boolean", f"{_CROSSED} or {_ON_EDGE}"),
    ("st_area", f"ring {_RING}", "double", f"abs({_AREA.format(_EDGES)})"),
    ("st_geomfromgeojson", "json string", _GEOMETRY, "transform(array(from_json(json, 'type string, coordinates string')), g -> if(g.type is null, null, g))[0]"),
    ("st_asgeojson", f"g {_GEOMETRY}", "string", """concat('{"type":"', g.type, '","coordinates":', g.coordinates, '}')"""),
    ("st_geomfromtext", "wkt string", _GEOMETRY, rf"""transform(transform(array(lower(regexp_extract(wkt, '(?i)^\\s*(?:srid=[0-9]+;)?\\s*(\\w+)', 1))), k -> transform(array(
        translate(regexp_replace(if(k = 'multipoint', concat('(', translate(substr(wkt, instr(wkt, '(')), '()', ''), ')'), substr(wkt, instr(wkt, '('))), r'{_NUMBER}\s+{_NUMBER}(\s+{_NUMBER})*', '[$1,$2]'), '() \n\t', '[]')), c -> named_struct(
        'type', element_at(map('point', 'Point', 'multipoint', 'MultiPoint', 'linestring', 'LineString', 'multilinestring', 'MultiLineString', 'polygon', 'Polygon', 'multipolygon', 'MultiPolygon'), k),
        'coordinates', if(instr(wkt, '(') = 0, '[]', if(k = 'point', regexp_extract(c, r'(\[[^\[\]]*\])', 1), trim(c)))))[0]), g -> if(g.type is null, null, g))[0]"""),
    ("st_rings", f"g {_GEOMETRY}", f"array<array<{_RING}>>", _RINGS),
    ("st_isempty", f"g {_GEOMETRY}", "boolean", "not rlike(g.coordinates, '[0-9]')"),
    ("st_centroid", f"g {_GEOMETRY}", _POINT, f"coalesce(if(g.type like '%Polygon', {_MEAN.format(_AREAS)}, null), if(g.type not like '%Point', {_MEAN.format(_STEPS)}, null), {_MEAN.format(_EVEN)})"),
    ("st_covers", f"g {_GEOMETRY}, a {_POINT}", "boolean", f"{_crossed(_ALL_EDGES)} or {_on_edge(_ALL_EDGES)}"),
    ("st_containsproperly", f"g {_GEOMETRY}, a {_POINT}", "boolean", f"{_crossed(_ALL_EDGES)} and not {_on_edge(_ALL_EDGES)}"),
    ("st_isvalid", f"g {_GEOMETRY}", "boolean", "if(g is null, null, g.coordinates is not null and coalesce(st_repair(g.type, g.coordinates).repair, 'valid') = 'valid')"),
    ("st_makevalid", f"g {_GEOMETRY}", _GEOMETRY, "if(g is null, null, transform(array(st_repair(g.type, g.coordinates)), m -> named_struct('type', m.type, 'coordinates', m.coordinates))[0])"),
)


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    spark.udf.register("st_repair", repair.made_valid_parts)
    for name, parameters, kind, body in FUNCTIONS:
        spark.sql(f"create or replace temporary function {name}({parameters}) returns {kind} return {body}")
