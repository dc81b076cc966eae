"""Spatial searches and joins over point layers with the columns lon and lat."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import geo
from lodestone.scratch import small_side, written

Ring = list[tuple[float, float]]


#: Rows of a key that are joined as one unit, about, and tasks for each core of a join that makes many rows of few.
UNIT, TASKS = 256, 8


def _met(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """The join of two tables on columns of both, without these, for a result that may be far larger than both.

    A key of more than UNIT rows on the left is dealt out in units and the rows of the right are copied to each, so that
    no task has a whole key of many. Tasks are as many as the result wants, which Spark can't see in the tables' sizes.
    """
    spark = left.sparkSession
    tasks = max(TASKS * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    a, b = [f"_l{i}" for i in range(len(left.columns))], [f"_r{i}" for i in range(len(right.columns))]
    keys = [f"_k{i}" for i in range(len(on))]
    copied = lambda df, names: df.toDF(*names).withColumns({k: F.col(names[df.columns.index(c)]) for k, c in zip(keys, on, strict=True)})
    x, y = copied(left, a), copied(right, b)
    units = x.groupBy(*keys).agg(F.ceil(F.count("*") / UNIT).alias("_units")).where("_units > 1")
    units = small_side(written(units, "units"))
    # The unit comes from what the row holds, so that a task that runs again deals the same. Maps have no hash.
    held = [n for n, f in zip(a, left.schema, strict=True) if "map<" not in f.dataType.simpleString()]
    x = x.join(units, keys, "left").withColumn("_unit", F.coalesce(F.pmod(F.xxhash64(*held), F.col("_units")), F.lit(0))).drop("_units")
    y = y.join(units, keys, "left").withColumn("_unit", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_units") - 1, F.lit(0))))).drop("_units")
    # Rows of a unit are few, so they are the side that is held for each row of the other.
    pairs = y.repartition(tasks, *keys, "_unit").join(x.repartition(tasks, *keys, "_unit").hint("merge"), [*keys, "_unit"])
    kept = [(n, c) for n, c in [*zip(a, left.columns, strict=True), *zip(b, right.columns, strict=True)] if c not in on]
    return pairs.select(*(n for n, _ in kept)).toDF(*(c for _, c in kept))


def _named(df: DataFrame, names: dict[str, Column]) -> DataFrame:
    """df with more columns; rows with a null in one of them stay out."""
    return df.withColumns(names).where(reduce(lambda a, b: a & b, (F.col(n).isNotNull() for n in names)))


def within_radius(points: DataFrame, refs: DataFrame, radius_m: float) -> DataFrame:
    """Each pair of a point and a reference (ref, ref_lon, ref_lat) at most radius_m apart, with distance_m (1 digit).

    Points lie in cubes of space as wide as the radius and references are copied to the cubes around theirs, so no
    pair is made that is more than two cubes apart, anywhere on the globe. Points without a place have no pair.
    Distances are taken once for each pair of places, however many points and references lie there.
    """
    p = _named(points, {"_lon": F.col("lon"), "_lat": F.col("lat")})
    r = _named(refs, {"_rlon": F.col("ref_lon"), "_rlat": F.col("ref_lat")})
    places = written(p.select("_lon", "_lat").distinct(), "places").withColumnsRenamed({"_lon": "lon", "_lat": "lat"})
    sites = written(r.select("_rlon", "_rlat").distinct(), "sites").withColumnsRenamed({"_rlon": "ref_lon", "_rlat": "ref_lat"})
    near = within_radius_raw(places, sites, radius_m).select(F.col("lon").alias("_lon"), F.col("lat").alias("_lat"), F.col("ref_lon").alias("_rlon"), F.col("ref_lat").alias("_rlat"), F.round("_d", 1).alias("distance_m"))
    return _met(p, r.join(near, ["_rlon", "_rlat"]).drop("_rlon", "_rlat"), ["_lon", "_lat"])


def nearest(points: DataFrame, lon: float, lat: float, k: int, key: str) -> DataFrame:
    """The k points nearest to a place, ties by key; a top-k that each partition makes first."""
    d = geo.haversine(F.col("lon"), F.col("lat"), F.lit(lon), F.lit(lat))
    return points.withColumn("distance_m", d).orderBy("distance_m", key).limit(k).withColumn("distance_m", F.round("distance_m", 1))


def nearest_each(points: DataFrame, refs: DataFrame, k: int, key: str, ref: str, start_m: float | None = None) -> DataFrame:
    """The k points nearest to each reference, by rings of growing radius: references that a radius leaves short go on with twice as much.

    The first radius, unless given, is that of a circle that would hold four times k points if they were spread evenly
    over their box. What a round finds and what it leaves are written, so that no round does the ones before again.
    References without a place have no points. Points of equal distance come in the order of key. Of the points of one
    place only the first k can be among the nearest, and references of one place have the same, which are found once.
    """
    first = Window.partitionBy("lon", "lat").orderBy(key)
    placed = points.where("lon is not null and lat is not null").withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") <= k).drop("_nth")
    placed = written(placed, "placed")
    box = placed.agg(F.count("*").alias("n"), *(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("lon", "lat"))).first()
    if not box.n:
        return _ranked(placed.limit(0).crossJoin(refs.limit(0)).withColumn("_d", F.lit(0.0)), ref, key).withColumn("distance_m", F.col("_d")).drop("_d")
    sited = _named(refs, {"_rlon": F.col("ref_lon"), "_rlat": F.col("ref_lat")})
    sites = written(sited.select(F.col("_rlon").alias("ref_lon"), F.col("_rlat").alias("ref_lat")).distinct().withColumn("_site", F.struct("ref_lon", "ref_lat")), "sites")
    if start_m is None:
        metre = math.pi / 180 * geo.EARTH
        wide = (box.max_lon - box.min_lon) * metre * math.cos(math.radians((box.max_lat + box.min_lat) / 2))
        start_m = max(1.0, math.sqrt(4 * k * max(wide, 1.0) * max((box.max_lat - box.min_lat) * metre, 1.0) / (math.pi * box.n)))
    found, left, radius = [], sites, start_m
    while left.take(1):
        near = within_radius_raw(placed, left, radius)
        near = _ranked(near, "_site", key).where(F.col("rank") <= k).withColumn("_n", F.count("*").over(Window.partitionBy("_site")))
        done = written(near.where(F.col("_n") >= min(k, box.n)).withColumn("distance_m", F.round("_d", 1)).drop("_d", "_n"), "nearest")
        found.append(done)
        left = written(left.join(done.select("_site").distinct(), "_site", "left_anti").select(*sites.columns), "references")
        radius *= 2
    if not found:
        return _ranked(placed.limit(0).crossJoin(refs.limit(0)).withColumn("_d", F.lit(0.0)), ref, key).withColumn("distance_m", F.col("_d")).drop("_d")
    best = reduce(DataFrame.unionByName, found).drop("_site").withColumnsRenamed({"ref_lon": "_rlon", "ref_lat": "_rlat"})
    own = [f"_r{i}" for i in range(len(refs.columns))]
    return best.join(sited.toDF(*own, "_rlon", "_rlat"), ["_rlon", "_rlat"]).select(*points.columns, *own, "rank", "distance_m").toDF(*points.columns, *refs.columns, "rank", "distance_m")


def within_radius_raw(points: DataFrame, refs: DataFrame, radius_m: float) -> DataFrame:
    """As within_radius, row by row, with the exact distance _d; beyond half of the globe every pair is near."""
    d = geo.haversine(F.col("lon"), F.col("lat"), F.col("ref_lon"), F.col("ref_lat"))
    p = points.withColumn("_cell", geo.space_cell(F.col("lon"), F.col("lat"), radius_m))
    r = refs.withColumn("_cell", F.explode(geo.near_space_cells(F.col("ref_lon"), F.col("ref_lat"), radius_m)))
    return _met(p, r, ["_cell"]).withColumn("_d", d).where(F.col("_d") <= radius_m)


def _ranked(pairs: DataFrame, ref: str, key: str) -> DataFrame:
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(ref).orderBy("_d", key)))


_BOX = ["minx", "miny", "maxx", "maxy"]


def _in_boxes(places: DataFrame, boxes: DataFrame, size: float) -> DataFrame:
    """Places in boxes: boxes are copied to the cells that they cover."""
    xs = F.sequence(F.floor(F.col("minx") / size), F.floor(F.col("maxx") / size))
    ys = F.sequence(F.floor(F.col("miny") / size), F.floor(F.col("maxy") / size))
    spread = boxes.withColumn("_x", F.explode(xs)).withColumn("_y", F.explode(ys)).withColumn("_cell", (F.col("_x") * 1_000_003 + F.col("_y")).cast("long")).drop("_x", "_y")
    p = places.withColumn("_cell", geo.cell(F.col("lon"), F.col("lat"), size))
    return _met(p, spread, ["_cell"]).where("lon between minx and maxx and lat between miny and maxy")


def _box_sides(points: DataFrame, boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The places of points with the number of their points (n), and the distinct boxes."""
    places = points.where("lon is not null and lat is not null").groupBy("lon", "lat").agg(F.count("*").alias("n"))
    return written(places, "places"), written(boxes.select(*_BOX).dropna().distinct(), "boxes")


def box_join(points: DataFrame, boxes: DataFrame, size: float) -> DataFrame:
    """Points in boxes (minx, miny, maxx, maxy; edges count). Places are held against distinct boxes, however many rows share them."""
    near = _in_boxes(*_box_sides(points, boxes), size).select(*(F.col(c).alias(f"_{c}") for c in ("lon", "lat", *_BOX)))
    p = _named(points, {"_lon": F.col("lon"), "_lat": F.col("lat")})
    b = _named(boxes, {f"_{c}": F.col(c) for c in _BOX}).join(near, [f"_{c}" for c in _BOX]).drop(*(f"_{c}" for c in _BOX))
    return _met(p, b, ["_lon", "_lat"])


def box_counts(points: DataFrame, boxes: DataFrame, size: float) -> DataFrame:
    """boxes with n, the number of points in each, without making the pairs; boxes without a point stay out."""
    n = _in_boxes(*_box_sides(points, boxes), size).groupBy(*_BOX).agg(F.sum("n").alias("n")).withColumnsRenamed({c: f"_{c}" for c in _BOX})
    return _named(boxes, {f"_{c}": F.col(c) for c in _BOX}).join(n, [f"_{c}" for c in _BOX]).drop(*(f"_{c}" for c in _BOX))


#: Degrees of the finest grid, and cells of its level that a shape covers at most in each direction.
FINEST, ACROSS = 0.001, 8


def _ends(rings: Column) -> tuple[Column, ...]:
    """minx, miny, maxx, maxy of the first ring."""
    xs, ys = F.transform(F.get(rings, 0), lambda p: p.x), F.transform(F.get(rings, 0), lambda p: p.y)
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def _gridded(shapes: DataFrame, rings: str) -> DataFrame:
    """shapes with their box and the level of the grid at which they cover ACROSS cells at most in each direction."""
    minx, miny, maxx, maxy = _ends(F.col(rings))
    boxed = shapes.where(F.size(rings) > 0).withColumns({"_minx": minx, "_miny": miny, "_maxx": maxx, "_maxy": maxy})
    span = F.greatest(F.col("_maxx") - F.col("_minx"), F.col("_maxy") - F.col("_miny"))
    return boxed.withColumn("_level", F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(span, F.lit(FINEST)) / (FINEST * (ACROSS - 1))))).cast("int"))


def _at(v: Column, level: Column) -> Column:
    return F.floor(v / (FINEST * F.pow(F.lit(2.0), level)))


def _covered(boxed: DataFrame, level: Column) -> DataFrame:
    """A row for each cell of a level that the box covers."""
    over = lambda low, high: F.explode(F.sequence(_at(F.col(low), level), _at(F.col(high), level)))
    return boxed.withColumn("_i", over("_minx", "_maxx")).withColumn("_j", over("_miny", "_maxy"))


def _levels(boxed: DataFrame) -> list[int]:
    return sorted(r[0] for r in boxed.select("_level").distinct().collect() if r[0] is not None)  # 20 or so


def polygon_join(points: DataFrame, polygons: DataFrame, predicate: str = "intersects") -> DataFrame:
    """Each pair of a point (lon, lat) and a polygon (rings: a shell, then holes, of struct<x,y>) that holds it.

    Polygons are copied to the cells of a grid that suits their size, points to theirs on each grid in use, and what
    meets is tested exactly, once for each pair of a place and a shape, however many rows share them. intersects counts
    the edges in, within doesn't. Polygons over the date line are to be cut there. Points without a place are in none.
    """
    p = _named(points, {"_lon": F.col("lon"), "_lat": F.col("lat")})
    shaped, shapes = _shapes(polygons, "rings", "_p")
    boxed = _gridded(shapes, "_prings")
    levels = _levels(boxed)
    if not levels:
        return points.crossJoin(polygons.limit(0))
    spread = _covered(boxed, F.col("_level"))
    places = written(p.select("_lon", "_lat").distinct(), "places").withColumn("_level", F.explode(F.array(*map(F.lit, levels))))
    places = places.withColumn("_i", _at(F.col("_lon"), F.col("_level"))).withColumn("_j", _at(F.col("_lat"), F.col("_level")))
    test = {"intersects": geo.meets_rings, "within": geo.within_rings}[predicate](F.col("_lon"), F.col("_lat"), F.col("_prings"))
    boxes = F.col("_lon").between(F.col("_minx"), F.col("_maxx")) & F.col("_lat").between(F.col("_miny"), F.col("_maxy"))
    near = _met(places, spread, ["_level", "_i", "_j"]).where(boxes).where(test).select("_lon", "_lat", "_phash", "_prings")
    return _met(p, shaped.join(near, ["_phash", "_prings"]).drop("_phash", "_prings"), ["_lon", "_lat"])


def _shapes(polygons: DataFrame, rings: str, name: str) -> tuple[DataFrame, DataFrame]:
    """polygons with their rings and a hash of them as the columns <name>rings and <name>hash, and the distinct ones of these."""
    shaped = polygons.where(F.size(rings) > 0).withColumns({f"{name}hash": F.xxhash64(rings), f"{name}rings": F.col(rings)})
    return shaped, written(shaped.select(f"{name}hash", f"{name}rings").distinct(), "shapes")


def layers_meet(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """(left_key, right_key) of each pair of polygons (rings) that have a point in common.

    Polygons are copied to the cells of their own level and, a few each, of the coarser ones; a pair meets at the
    coarser level of its two, and is tested in the one cell in which its boxes' common part begins. Equal polygons are
    tested as one.
    """
    lefts, a = _shapes(left.select(left_key, "rings"), "rings", "_a")
    rights, b = _shapes(right.select(right_key, "rings"), "rings", "_b")
    a, b = _gridded(a, "_arings"), _gridded(b, "_brings")
    levels = sorted({*_levels(a), *_levels(b)})
    if not levels:
        return left.select(left_key).crossJoin(right.select(right_key)).limit(0)

    def spread(boxed: DataFrame) -> DataFrame:
        at = boxed.withColumn("_own", F.col("_level")).withColumn("_level", F.explode(F.filter(F.array(*map(F.lit, levels)), lambda x: x >= F.col("_own"))))
        return _covered(at, F.col("_level"))

    named = {f"_{c}": f"_b{c}" for c in ("minx", "miny", "maxx", "maxy", "own")}
    pairs = _met(spread(a), spread(b).withColumnsRenamed(named).withColumns({"_at": F.col("_level"), "_ati": F.col("_i"), "_atj": F.col("_j")}), ["_level", "_i", "_j"])
    pairs = pairs.where("_at = greatest(_own, _bown)")
    pairs = pairs.where("_minx <= _bmaxx and _bminx <= _maxx and _miny <= _bmaxy and _bminy <= _maxy")
    first = (F.col("_ati") == _at(F.greatest("_minx", "_bminx"), F.col("_at"))) & (F.col("_atj") == _at(F.greatest("_miny", "_bminy"), F.col("_at")))
    near = pairs.where(first).where(geo.rings_meet(F.col("_arings"), F.col("_brings"))).select("_ahash", "_arings", "_bhash", "_brings")
    some = rights.join(near, ["_bhash", "_brings"]).select(right_key, "_ahash", "_arings")
    return _met(lefts.select(left_key, "_ahash", "_arings"), some, ["_ahash", "_arings"])


def area_buffer(points: DataFrame, rings: list[Ring], metres: float) -> DataFrame:
    """Points in a polygon or at most so many metres from its edges; distance_m is 0 inside."""
    rings = validate_rings(rings)
    near = F.least(*(geo.distance_to_line(F.col("lon"), F.col("lat"), r) for r in rings)) if len(rings) > 1 else geo.distance_to_line(F.col("lon"), F.col("lat"), rings[0])
    d = F.when(geo.intersects(F.col("lon"), F.col("lat"), rings), 0.0).otherwise(near)
    return points.withColumn("distance_m", F.round(d, 1)).where(d <= metres)


def search_polygon(layer: DataFrame, rings: list[Ring], key: str, predicate: str = "intersects", limit: int = 1000, offset: int = 0) -> DataFrame:
    """A page of the features in a polygon, in the order of key; limit 1 to 10000. count_polygon gives their number."""
    test = {"intersects": geo.intersects, "within": geo.contains}[predicate]
    hits = layer.where(test(F.col("lon"), F.col("lat"), validate_rings(rings)))
    return hits.orderBy(key).offset(max(0, offset)).limit(min(10_000, max(1, limit)))


def count_polygon(layer: DataFrame, rings: list[Ring], predicate: str = "intersects") -> DataFrame:
    """One row: total, the number of the features in a polygon, whatever the page."""
    test = {"intersects": geo.intersects, "within": geo.contains}[predicate]
    return layer.where(test(F.col("lon"), F.col("lat"), validate_rings(rings))).agg(F.count("*").alias("total"))


def search_layers(layers: dict[str, DataFrame], rings: list[Ring], predicate: str = "intersects") -> DataFrame:
    """The features of all layers in a polygon, tagged with _layer; layers without lon and lat are an error.

    intersects counts the edges in, within doesn't; half_open counts a point on an edge to one of its two sides.
    """
    test = {"intersects": geo.intersects, "within": geo.contains, "half_open": geo.half_open}[predicate](F.col("lon"), F.col("lat"), validate_rings(rings))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.where(test).withColumn("_layer", F.lit(name)) for name, df in layers.items()])


def clip(result: DataFrame, rings: list[Ring]) -> DataFrame:
    """The rows of a result that a polygon meets; a failure is raised, never answered without the clip."""
    return result.where(geo.intersects(F.col("lon"), F.col("lat"), validate_rings(rings)))


def buffered(points: DataFrame, line: Ring, metres: float) -> DataFrame:
    """Points at most so many metres from a line."""
    d = geo.distance_to_line(F.col("lon"), F.col("lat"), line)
    return points.withColumn("distance_m", F.round(d, 1)).where(d <= metres)


def bbox(points: DataFrame) -> DataFrame:
    return points.agg(F.min("lon").alias("minx"), F.min("lat").alias("miny"), F.max("lon").alias("maxx"), F.max("lat").alias("maxy"))


def validate_rings(rings: list[Ring]) -> list[Ring]:
    """Closed rings of at least three distinct points within WGS84."""
    if not rings or not rings[0]:
        raise ValueError("an empty polygon")
    out = []
    for ring in rings:
        ring = ring if ring[0] == ring[-1] else [*ring, ring[0]]
        if len(set(ring)) < 3:
            raise ValueError("a ring needs three points")
        if any(not (-180 <= x <= 180 and -90 <= y <= 90) for x, y in ring):
            raise ValueError("coordinates outside WGS84")
        out.append(ring)
    return out


def parse_polygons(text: str) -> list[list[Ring]]:
    """The polygons of a text, a list of rings each: GeoJSON (a geometry, feature or collection), a coordinate list, WKT, or lines of `lon lat`."""
    import json

    text = text.strip()
    if text[:1] in "{[":
        data = json.loads(text)
        while isinstance(data, dict) and data.get("type") in ("FeatureCollection", "Feature"):
            data = next(f for f in data["features"] if (f.get("geometry") or {}).get("type") in ("Polygon", "MultiPolygon")) if "features" in data else data["geometry"]
        if isinstance(data, dict):
            if data.get("type") not in ("Polygon", "MultiPolygon"):
                raise ValueError(f"no polygon: {data.get('type')}")
            parts = data["coordinates"] if data["type"] == "MultiPolygon" else [data["coordinates"]]
        else:
            parts = [[data] if isinstance(data[0][0], (int, float)) else data]
        return [validate_rings([[(float(x), float(y)) for x, y, *_ in r] for r in rings]) for rings in parts]
    if m := re.match(r"(?is)^(?:srid=\d+;)?\s*(multi)?polygon\s*\((.*)\)$", text):
        parts = re.findall(r"\(((?:\s*\([^()]*\)\s*,?)+)\)", m[2]) if m[1] else [m[2]]
        return [validate_rings([[tuple(map(float, p.split()[:2])) for p in r.split(",")] for r in re.findall(r"\(([^()]*)\)", part)]) for part in parts]
    return [validate_rings([[tuple(map(float, re.split(r"[,\s]+", line.strip())[:2])) for line in text.splitlines() if line.strip()]])]


def parse_polygon(text: str) -> list[Ring]:
    """The rings of the one polygon of a text; an error where it has several."""
    polygons = parse_polygons(text)
    if len(polygons) > 1:
        raise ValueError(f"{len(polygons)} polygons where one is asked for")
    return polygons[0]


def resolve_layer(wanted: str, names: list[str]) -> str | None:
    """A layer by its name or plural, else by part of a name, else the only one."""
    w = wanted.strip().lower()
    alike = {w, w + "s", w.removesuffix("s"), w.removesuffix("es"), re.sub("ies$", "y", w), re.sub("y$", "ies", w)}
    exact = [n for n in names if n.lower() in alike]
    part = [n for n in names if w and (w in n.lower() or n.lower() in w)]
    return next(iter([*exact, *part, *(names if len(names) == 1 else [])]), None)


def geocode(layer: DataFrame, label: str, place: str, key: str) -> DataFrame:
    """The feature whose label has the place in it, the shortest label first."""
    return layer.where(F.lower(F.col(label)).contains(place.lower())).orderBy(F.length(label), label, key).limit(1)


def mentioned(layer: DataFrame, label: str, answers: DataFrame, min_length: int = 5) -> DataFrame:
    """(answer_id, label) of labels of min_length or more that stand in an answer as whole words, for both of any size.

    Labels and answers meet by the label's first word, so that no answer is held against all labels.
    """
    words = r"[^\p{L}\p{N}#]+"
    first = F.get(F.split(F.lower(F.col(label)), words), 0)
    names = layer.where(F.length(label) >= min_length).select(F.col(label).alias("label"), first.alias("_w")).distinct()
    each = answers.select("answer_id", F.lower("text").alias("_t"), F.explode(F.array_distinct(F.split(F.lower("text"), words))).alias("_w"))
    return each.join(names, "_w").where(F.col("_t").contains(F.lower("label"))).select("answer_id", "label").distinct()


# How a routing question names its means, its two places, and a means at the end of a place.
ON_FOOT, BY_BIKE = r"(?i)\b(walk|walking|on foot|pedestrian)\b", r"(?i)\b(bike|bicycle|cycl)\w*\b"
PLACES = (r"(?i)\bfrom\s+(.+?)\s+to\s+(.+?)\s*[\?\.!]*$", r"(?i)\bbetween\s+(.+?)\s+and\s+(.+?)\s*[\?\.!]*$")
MEANS = r"(?i)\s+(by car|by bike|by bicycle|on foot|by foot|walking|driving|cycling)\s*$"


def route_request(query: Column) -> Column:
    """struct(origin, destination, mode) of a routing question; null places where none are named."""
    mode = F.when(query.rlike(ON_FOOT), "pedestrian").when(query.rlike(BY_BIKE), "bicycle").otherwise("auto")
    place = lambda c: F.trim(F.regexp_replace(F.trim(c), MEANS, ""), F.lit("\"'?.! "))
    named = lambda i: F.coalesce(*(F.when(query.rlike(p), place(F.regexp_extract(query, p, i))) for p in PLACES))
    return F.struct(named(1).alias("origin"), named(2).alias("destination"), mode.alias("mode"))
