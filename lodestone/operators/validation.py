"""Validation and cleaning of feature layers, one feature a row.

Features have _src_index, geometry (type and coordinates as text) and properties (a map of texts). Each check is an
expression; the first geometry check that fails names the feature's problem, and a feature with one stays pending
until a decision is joined to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import geo
from lodestone.functions.text import blank, number
from lodestone.scratch import small_side, written

TYPES = ("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon")
DEPTH = dict(zip(TYPES, (0, 1, 1, 2, 2, 3), strict=True))
MAX_FEATURES, MAX_VERTICES, MAX_EXTENT, DUPLICATE_SHARE = 100_000, 10_000, 60.0, 0.05
# Parts of the names of fields that can't be negative.
COUNT_HINTS = ("capacity", "count", "population", "students", "beds", "size", "area", "number", "num_", "qty", "quantity", "rooms")
ID_NAMES = ("id", "ID", "fid", "gid", "objectid", "OBJECTID")


def rings(geometry: str = "geometry") -> Column:
    """All positions of a geometry as an array of parts, each an array of struct<x,y>; null where they don't parse."""
    text = F.col(f"{geometry}.coordinates")
    point = lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y"))
    part = lambda xs: F.transform(xs, point)
    read = lambda depth: F.from_json(text, "array<" * depth + "array<double>" + ">" * depth)
    out = F.when(F.col(f"{geometry}.type") == "Point", F.array(F.array(point(read(0)))))
    for kind in TYPES[1:]:
        d = DEPTH[kind]
        parts = F.array(read(1)) if d == 1 else read(2) if d == 2 else F.flatten(read(3))
        out = out.when(F.col(f"{geometry}.type") == kind, F.transform(parts, part))
    return out


def closed(ring: Column) -> Column:
    """A ring that ends where it begins; an empty one stays empty."""
    return F.when((F.size(ring) > 0) & (F.get(ring, 0) != F.element_at(ring, -1)), F.concat(ring, F.slice(ring, 1, 1))).otherwise(ring)


def without_repeats(line: Column) -> Column:
    """The vertices that differ from the one before."""
    return F.filter(line, lambda p, i: (i == 0) | (p != F.get(line, i - 1)))


def swapped(parts: Column) -> Column:
    return F.transform(parts, lambda r: F.transform(r, lambda p: F.struct(p.y.alias("x"), p.x.alias("y"))))


def checked(features: DataFrame) -> DataFrame:
    """features with parts (cleaned), issue (the first failing check or null), options, fixes, complex and pending.

    options: what may be decided about the issue. A feature without area or with crossing edges can be kept as it is,
    a broken one can't. Crossing edges are found among the edges of each ring, and nothing is repaired.
    """
    rows = features.withColumn("parts", rings())
    area = F.col("geometry.type").isin("Polygon", "MultiPolygon")
    line = F.col("geometry.type").isin("LineString", "MultiLineString")
    flat = F.flatten("parts")
    tidy = F.when(area, F.transform("parts", lambda r: closed(without_repeats(r)))).when(line, F.transform("parts", without_repeats)).otherwise(F.col("parts"))
    rows = rows.withColumn("tidy", tidy)
    swap = F.exists(flat, lambda p: (F.abs(p.y) > 90) & (F.abs(p.y) <= 180) & (F.abs(p.x) <= 90))
    off = F.exists(flat, lambda p: p.x.isNull() | p.y.isNull() | (F.abs(p.x) > 180) | (F.abs(p.y) > 90))
    short = (area & F.exists("tidy", lambda r: F.size(r) < 4)) | (line & F.exists("tidy", lambda r: F.size(r) < 2))
    shoelace = lambda r: F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(r) - 1, F.lit(1))), F.lit(0.0), lambda s, i: s + F.coalesce(F.get(r, i - 1).x * F.get(r, i).y - F.get(r, i).x * F.get(r, i - 1).y, F.lit(0.0)))
    issue = (
        F.when(F.col("geometry").isNull() | F.col("geometry.type").isNull(), "missing_geometry").when(~F.col("geometry.type").isin(*TYPES), "unsupported_type")
        .when(F.col("parts").isNull() | (F.size(flat) == 0), "empty_coordinates").when(swap, "swapped_coordinates").when(off, "out_of_range")
        .when(short, "too_few_vertices").when(area & F.exists("tidy", lambda r: F.abs(shoelace(r)) == 0), "zero_area")
        .when(area & F.exists("tidy", geo.self_crossing), "self_crossing")
    )
    rows = rows.withColumn("issue", issue)
    fixes = F.filter(F.array(
        F.when(area & F.exists("parts", lambda r: (F.size(r) > 0) & (F.get(r, 0) != F.element_at(r, -1))), F.lit("ring_closed")),
        F.when((area | line) & F.exists("parts", lambda r: F.size(without_repeats(r)) < F.size(r)), F.lit("repeated_vertices")),
    ), lambda x: x.isNotNull())
    return rows.withColumn("fixes", fixes).withColumn("complex", F.size(flat) > MAX_VERTICES).withColumn("pending", F.col("issue").isNotNull()).withColumn("options", options_of(F.col("issue"))).withColumn("parts", F.col("tidy")).drop("tidy")


#: What may be decided about each issue of a feature.
OPTIONS = {
    "missing_geometry": ("drop", "fix"), "unsupported_type": ("drop",), "empty_coordinates": ("drop",), "swapped_coordinates": ("fix", "keep", "skip"), "out_of_range": ("drop",),
    "too_few_vertices": ("drop",), "zero_area": ("keep", "drop"), "self_crossing": ("keep", "drop"),
}
#: How grave issues and fixes are.
SEVERITY = dict.fromkeys(OPTIONS, "important") | {"ring_closed": "warning", "repeated_vertices": "warning", "complex": "warning"}


def options_of(issue: Column) -> Column:
    known = F.create_map(*(x for k, v in OPTIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return known[issue]


def issues(checked_rows: DataFrame) -> DataFrame:
    """_src_index, kind, severity and fixed of each issue and fix of checked features."""
    found = F.concat(F.array("issue"), F.col("fixes"), F.array(F.when(F.col("complex"), F.lit("complex"))))
    each = checked_rows.select("_src_index", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("kind"))
    grave = F.create_map(*(F.lit(x) for pair in SEVERITY.items() for x in pair))
    return each.withColumn("severity", grave[F.col("kind")]).withColumn("fixed", F.col("kind").isin("ring_closed", "repeated_vertices"))


def summary(checked_rows: DataFrame) -> DataFrame:
    """One row: total, accepted, pending, auto_fixed and the numbers of important and of warning issues."""
    count = lambda xs, kind: F.sum(F.size(F.filter(xs, lambda x: F.create_map(*(F.lit(v) for pair in SEVERITY.items() for v in pair))[x] == kind)))
    found = F.filter(F.concat(F.array("issue"), F.col("fixes"), F.array(F.when(F.col("complex"), F.lit("complex")))), lambda x: x.isNotNull())
    sums = checked_rows.agg(
        F.count("*").alias("total"), F.count_if(~F.col("pending")).alias("accepted"), F.count_if("pending").alias("pending"), F.sum(F.size("fixes")).alias("auto_fixed"),
        count(found, "important").alias("important"), count(found, "warning").alias("warning"),
    )
    return sums.select(*(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in sums.columns))


def feature_cap(features: DataFrame, most: int = MAX_FEATURES) -> DataFrame:
    """One row: n, and whether it has to be decided if so many go on."""
    return features.agg(F.count("*").alias("n")).withColumn("decide", F.col("n") > most)


def coordinate_columns(features: DataFrame, declared: list[str]) -> DataFrame:
    """name, dtype and null_count of the declared columns that hold a point's lon or lat, which lie in its geometry."""
    axes = {n: i for i, names in enumerate((("longitude", "lon", "lng", "long", "x"), ("latitude", "lat", "y"))) for n in names}  # fixed values
    wanted = [(n, axes[n]) for n in dict.fromkeys(c.strip().lower() for c in declared) if n in axes]
    if not wanted:
        return features.sparkSession.createDataFrame([], "name string, dtype string, null_count long")
    at = F.when(F.col("geometry.type") == "Point", F.from_json("geometry.coordinates", "array<double>"))
    one = features.select(at.alias("at")).agg(*(F.count_if(F.get("at", i).isNull()).alias(n) for n, i in wanted))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit("float").alias("dtype"), F.col(f"`{n}`").alias("null_count")) for n, _ in wanted))).alias("r")).select("r.*")


def duplicate_geometries(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """rows with duplicate: an earlier row has the same key. A row without key is like no other.

    Keys that occur again are a table of their own, so that Spark can split the rows of a frequent one.
    """
    keyed = rows.withColumn("_key", key)
    first = keyed.where("_key is not null").groupBy("_key").agg(F.min(order).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    found = keyed.where("_key is not null").join(small_side(written(first, "repeated-keys")), "_key", "left").withColumn("duplicate", F.coalesce(F.col(order) > F.col("_first"), F.lit(False)))
    none = keyed.where("_key is null").withColumn("duplicate", F.lit(False))
    return found.drop("_key", "_first").unionByName(none.drop("_key"))


def duplicates_need_decision(rows: DataFrame) -> DataFrame:
    """n, n_duplicate and whether they are more than DUPLICATE_SHARE; one row."""
    return rows.agg(F.count("*").alias("n"), F.count_if("duplicate").alias("n_duplicate")).withColumn("decide", F.col("n_duplicate") > DUPLICATE_SHARE * F.col("n"))


def unique_ids(rows: DataFrame, id_: str, order: str) -> DataFrame:
    """rows with new_id: the first of equal ids keeps it, others get one that is made of id and place.

    Rows without id, which may be most of them, get theirs where they stand.
    """
    nth = F.row_number().over(Window.partitionBy(id_).orderBy(order))
    made = F.concat(F.lit("u-"), F.substring(F.sha1(F.concat_ws(":", F.col(id_).cast("string"), F.col(order).cast("string"))), 1, 16))
    named = rows.where(F.col(id_).isNotNull()).withColumn("new_id", F.when(nth == 1, F.col(id_).cast("string")).otherwise(made))
    return named.unionByName(rows.where(F.col(id_).isNull()).withColumn("new_id", made))


def empty_to_null(rows: DataFrame, required: tuple[str, ...] = ()) -> DataFrame:
    return rows.withColumns({c: F.when(F.trim(c) != "", F.col(c)) for c, t in rows.dtypes if t == "string" and c not in required})


def coerced(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Numeric fields as doubles; {field}_failed where a value that is not blank did not parse."""
    return rows.withColumns({f"{c}_failed": ~blank(F.col(c)) & number(F.col(c)).isNull() for c in fields}).withColumns({c: number(F.col(c)) for c in fields})


def negative_outliers(rows: DataFrame) -> Column:
    """Names of the fields that hold a negative value though they count something."""
    fields = [c for c, t in rows.dtypes if any(h in c.lower() for h in COUNT_HINTS)]
    return F.filter(F.array(*(F.when(number(F.col(c)) < 0, F.lit(c)) for c in fields)), lambda x: x.isNotNull()) if fields else F.array().cast("array<string>")


def missing_required(rows: DataFrame, required: list[str]) -> Column:
    return F.filter(F.array(*(F.when(blank(F.col(c)), F.lit(c)) for c in required)), lambda x: x.isNotNull())


def extent(points: DataFrame) -> DataFrame:
    """span_x, span_y and whether either is over MAX_EXTENT degrees."""
    span = points.agg((F.max("lon") - F.min("lon")).alias("span_x"), (F.max("lat") - F.min("lat")).alias("span_y"))
    return span.withColumn("wide", (F.col("span_x") > MAX_EXTENT) | (F.col("span_y") > MAX_EXTENT))


def upper_median(points: DataFrame, column: str) -> DataFrame:
    """The value at place n // 2 of the sorted values, without gathering them: counts of values, then their running sum by ranges."""
    counts = points.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    part = F.floor(F.col(column) * 16)  # sums of ranges first, so that no window runs over all values
    by_part = counts.groupBy(part.alias("part")).agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    ends = by_part.withColumn("end", F.sum("n").over(Window.orderBy("part"))).withColumn("half", F.floor(total / 2))
    home = ends.where("end > half and end - n <= half").select("part", (F.col("end") - F.col("n")).alias("before"), "half")
    inner = counts.withColumn("part", part).join(F.broadcast(home), "part").withColumn("end", F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy(column)))
    return inner.where("end > half and end - n <= half").select(F.col(column).alias("median"))


def spatial_outliers(points: DataFrame) -> DataFrame:
    """Points over four standard deviations and over one degree from the upper-median centre."""
    centre = upper_median(points, "lon").select(F.col("median").alias("_cx")).crossJoin(upper_median(points, "lat").select(F.col("median").alias("_cy")))
    off = points.crossJoin(F.broadcast(centre)).withColumn("_d", F.sqrt(F.pow(F.col("lon") - F.col("_cx"), 2) + F.pow(F.col("lat") - F.col("_cy"), 2)))
    stats = off.agg(F.avg("_d").alias("_m"), F.stddev_pop("_d").alias("_s"))
    return off.crossJoin(F.broadcast(stats)).where("_d > _m + 4 * _s and _d > 1.0").drop("_cx", "_cy", "_d", "_m", "_s")


def column_report(rows: DataFrame) -> DataFrame:
    """column, dtype (string, integer, number, boolean, mixed or null) and nulls (blanks too) of text columns."""
    def kinds(c: str) -> Column:
        v = F.lower(F.trim(F.col(c)))
        full = ~blank(F.col(c))
        n = lambda test: F.count_if(full & test)
        return F.struct(F.count_if(full).alias("n"), n(v.isin("true", "false")).alias("b"), n(v.rlike(r"^[+-]?\d+$")).alias("i"), n(number(F.col(c)).isNotNull()).alias("f"), F.count_if(~full).alias("nulls")).alias(c)

    one = rows.agg(*(kinds(c) for c in rows.columns))
    each = one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("k")) for c in rows.columns))).alias("r")).select("r.column", "r.k.*")
    dtype = F.when(F.col("n") == 0, "null").when(F.col("b") == F.col("n"), "boolean").when(F.col("i") == F.col("n"), "integer").when(F.col("f") == F.col("n"), "number").when(F.col("f") + F.col("b") > 0, "mixed").otherwise("string")
    return each.select("column", dtype.alias("dtype"), "nulls")


def resolve(pending: DataFrame, decisions: DataFrame) -> DataFrame:
    """Pending items (kind, feature_index, field) with the action decided for them; those without one have none."""
    d = decisions.select(F.col("kind").alias("_kind"), F.col("feature_index").alias("_index"), F.col("field").alias("_field"), "action")
    same = (F.col("kind") == F.col("_kind")) & (F.col("feature_index") == F.col("_index")) & F.col("field").eqNullSafe(F.col("_field"))
    return pending.join(d, same, "left").drop("_kind", "_index", "_field")


def resolve_all(pending: DataFrame, kind: str, action: str) -> DataFrame:
    """Pending items with one action for all of a kind; a question of the whole file's crs is never decided so."""
    return pending.withColumn("action", F.when((F.col("kind") == kind) & (F.col("kind") != "crs"), F.lit(action)))


def _keys(rows: DataFrame, decisions: DataFrame) -> list[str]:
    """The columns that name a feature: its place, and its file where both sides have it."""
    return ["_src_index", *(["_source"] if "_source" in rows.columns and "_source" in decisions.columns else [])]


def committed(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """The features after decisions (_src_index, perhaps _source, action: fix, keep or drop) are carried out; an error while any is pending."""
    acted = rows.join(decisions, _keys(rows, decisions), "left")
    open_ = F.col("pending") & F.col("action").isNull()
    fixed = F.when(F.col("action") == "fix", swapped(F.col("parts"))).otherwise(F.col("parts"))
    checked_ = acted.withColumn("action", F.when(open_, F.raise_error(F.lit("features are pending"))).otherwise(F.coalesce("action", F.lit("keep"))))
    return checked_.where("action != 'drop' and geometry is not null").withColumn("parts", fixed).drop("action").select(*rows.columns)


def finalized(rows: DataFrame, decisions: DataFrame, drop_duplicates: bool = False) -> DataFrame:
    """The features (_src_index, geometry, parts, properties) as the decisions on them leave them.

    decisions: _src_index, perhaps _source, kind, field, action and value. By kind, these actions do something:
    missing_geometry drop, or fix and autofill with value as the geometry's GeoJSON; missing_attribute drop, or fix
    and autofill with value; swapped_coordinates skip (the feature goes) and fix; outlier null, or fix with value;
    invalid_geometry drop. Others keep what is there. Features without geometry go in the end; with drop_duplicates
    only the first of equal geometries stays. The last decision on a field in the order of its kind counts.
    """
    keys = _keys(rows, decisions)
    kind, action, filled = F.col("kind"), F.col("action"), F.col("action").isin("fix", "autofill")
    drop = (kind.isin("missing_geometry", "missing_attribute", "invalid_geometry") & (action == "drop")) | ((kind == "swapped_coordinates") & (action == "skip"))
    sets = ((kind == "missing_attribute") & filled) | ((kind == "outlier") & action.isin("null", "fix"))
    value = F.when(~((kind == "outlier") & (action == "null")), F.col("value"))
    per = decisions.groupBy(*keys).agg(
        F.bool_or(drop).alias("_drop"), F.bool_or((kind == "swapped_coordinates") & (action == "fix")).alias("_swap"), F.max(F.when((kind == "missing_geometry") & filled, F.col("value"))).alias("_geometry"),
        F.array_sort(F.collect_list(F.when(sets, F.struct("field", "kind", value.alias("value"))))).alias("_set"),
    )
    given = F.from_json("_geometry", "type string, coordinates string")
    last = F.map_from_entries(F.transform(F.filter("_set", lambda x, i: (i + 1 == F.size("_set")) | (F.get("_set", i + 1).field != x.field)), lambda x: F.struct(x.field, x.value)))
    props = F.coalesce("properties", F.create_map().cast("map<string,string>"))
    acted = rows.join(per, keys, "left").where(~F.coalesce("_drop", F.lit(False)))
    acted = acted.withColumn("geometry", F.when(F.col("_geometry").isNotNull(), given).otherwise(F.col("geometry"))).where("geometry is not null")
    acted = acted.withColumn("parts", F.when(F.col("_geometry").isNotNull(), rings()).when(F.coalesce("_swap", F.lit(False)), swapped(F.col("parts"))).otherwise(F.col("parts")))
    changed = F.map_concat(F.map_filter(props, lambda k, _: ~F.array_contains(F.map_keys("_new"), k)), F.col("_new"))
    acted = acted.withColumn("_new", last).withColumn("properties", F.when(F.size("_set") > 0, changed).otherwise(F.col("properties"))).drop("_new")
    out = acted.select(*rows.columns)
    if drop_duplicates:
        out = duplicate_geometries(out, F.to_json(F.struct("geometry.type", "parts")), "_src_index").where("not duplicate").drop("duplicate")
    return out


def web_mercator_to_lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    """EPSG:3857 to lon and lat; other systems are refused by the readers."""
    r = 6378137.0
    return F.degrees(x / r), F.degrees(2 * F.atan(F.exp(y / r)) - F.pi() / 2)
