"""Readers and writers of feature layers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import geo
from lodestone.operators import validation
from lodestone.plans.catalog import sanitized
from lodestone.scratch import exists, file_system
from lodestone.sources.split_geojson import split_collections, with_collections

# Column names of latitude and longitude, the first found counts.
LAT, LON = ("lat", "latitude", "y"), ("lon", "lng", "long", "longitude", "x")
# The largest file, in bytes, and the endings of its name.
MAX_BYTES, ENDINGS = 100 << 20, ("geojson", "json")
_FEATURE = "id string, geometry string, properties map<string,string>"
_SCHEMA = f"type string, crs string, features array<struct<{_FEATURE.replace(' ', ':').replace(',:', ',')}>>"


def file_checks(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """source, length and reason (null for a good file): extension, size, encoding, syntax, no_collection, no_features or empty.

    The content of files over max_bytes is not read.
    """
    files = spark.read.format("binaryFile").load(path)
    named = ~F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*ENDINGS)
    text = F.col("content").cast("string")
    member = lambda name: F.get_json_object(text, f"$.{name}")
    inner = (
        F.when(named, "extension").when(~F.is_valid_utf8(text), "encoding").when(F.get_json_object(text, "$").isNull(), "syntax")
        .when(F.coalesce(member("type"), F.lit("")) != "FeatureCollection", "no_collection").when(~F.coalesce(F.trim(member("features")).startswith("["), F.lit(False)), "no_features")
        .when(F.trim(member("features")).rlike(r"^\[\s*\]$"), "empty")
    )
    large = files.where(F.col("length") > max_bytes).select(F.col("path").alias("source"), "length", F.when(named, "extension").otherwise("size").alias("reason"))
    return files.where(F.col("length") <= max_bytes).select(F.col("path").alias("source"), "length", inner.alias("reason")).unionByName(large)


def epsg_of(crs: Column) -> Column:
    """The EPSG code that a crs member (JSON text) names; 4326 where there is none, null where it can't be told."""
    name = F.upper(F.coalesce(F.get_json_object(crs, "$.properties.name"), F.lit("")))
    code = F.regexp_extract(name, r"(?:^|[\s:])([0-9]+)(?=$|[\s:])", 1)
    return F.when(crs.isNull() | (F.trim(crs).isin("null", "", "{}")), 4326).when(name.contains("CRS84") | name.contains("4326"), 4326).when(code != "", code.try_cast("int"))


def to_lonlat(x: Column, y: Column, epsg: Column) -> tuple[Column, Column]:
    """Lon and lat of a position in EPSG 4326, 3857 (also 900913) or the UTM zones of WGS84 (326xx, 327xx); else an error."""
    mercator = validation.web_mercator_to_lonlat(x, y)
    utm = geo.from_utm(x, y, (epsg % 100).cast("double"), epsg >= 32700)
    refused = F.raise_error(F.concat(F.lit("no conversion from EPSG "), F.coalesce(epsg.cast("string"), F.lit("that is not named")))).cast("double")
    is_utm = epsg.between(32601, 32660) | epsg.between(32701, 32760)
    pick = lambda i, same: F.when(epsg == 4326, same).when(epsg.isin(3857, 900913), mercator[i]).when(is_utm, utm[i]).otherwise(refused)
    return pick(0, x), pick(1, y)


def _converted(kind: Column, text: Column, epsg: Column) -> Column:
    """The coordinates of a geometry as text in lon and lat; a third number and more stay."""
    def at(p: Column) -> Column:
        lon, lat = to_lonlat(F.get(p, 0), F.get(p, 1), epsg)
        return F.concat(F.array(lon, lat), F.slice(p, 3, F.greatest(F.size(p) - 2, F.lit(1))))

    def nested(depth: int):
        return at if not depth else lambda c: F.transform(c, nested(depth - 1))

    out = F.lit(None).cast("string")
    for name in validation.TYPES:
        depth = validation.DEPTH[name]
        read = F.from_json(text, "array<" * depth + "array<double>" + ">" * depth)
        out = F.when(kind == name, F.to_json(nested(depth)(read))).otherwise(out)
    return F.when(epsg == 4326, text).otherwise(out)


def _features(rows: DataFrame) -> DataFrame:
    """_source, _src_index, epsg, id, geometry and properties of rows (_source, _src_index, epsg, f)."""
    g = F.from_json("f.geometry", "type string, coordinates string")
    at = F.when(F.col("epsg").isNull(), F.raise_error(F.lit("a crs that can't be told"))).otherwise(F.col("epsg"))
    rows = rows.select("_source", "_src_index", at.alias("epsg"), "f.id", g.alias("g"), "f.properties")
    moved = F.struct(F.col("g.type").alias("type"), _converted(F.col("g.type"), F.col("g.coordinates"), F.col("epsg")).alias("coordinates"))
    return rows.select("_source", "_src_index", "epsg", "id", F.when(F.col("g").isNotNull(), moved).alias("geometry"), "properties")


def read_geojson(spark: SparkSession, path: str, crs: str | None = None) -> DataFrame:
    """Features with _source, _src_index (the place in the file), epsg, id, geometry (type, coordinates as text) and properties.

    A file holds one feature collection and is read by one task; read_geojson_split is for larger ones. Coordinates
    become lon and lat: from the system that the file's crs member names, or from crs (EPSG:<code>) where it is
    given. What can't be converted is an error.
    """
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("_source"), F.from_json("value", _SCHEMA).alias("c"))
    checked = F.when(F.coalesce(F.col("c.type"), F.lit("")) != "FeatureCollection", F.raise_error(F.lit("no feature collection"))).otherwise(F.col("c.features"))
    each = raw.select("_source", _epsg(crs, F.col("c.crs")).alias("epsg"), F.posexplode(checked).alias("_src_index", "f"))
    return _features(each)


def read_geojson_split(spark: SparkSession, path: str, crs: str | None = None) -> DataFrame:
    """As read_geojson, with the same rows, but each file is split over tasks, in blocks of spark.sql.files.maxPartitionBytes.

    For collections of any size: no task holds more than a block and the features that begin in it. Files are read
    twice and their features written to the shared folder once. Objects in lists of other members than features must
    not stand in the collection.
    """
    texts, around = split_collections(spark, path)
    head = around.select("_source", F.from_json("value", "type string, crs string").alias("c"))
    head = head.select("_source", _epsg(crs, F.col("c.crs")).alias("epsg"), F.coalesce(F.col("c.type"), F.lit("")).alias("_type"))
    bad = head.where("_type <> 'FeatureCollection'").select("_source").first()
    if bad:
        raise ValueError(f"no feature collection in {bad._source}")
    each = with_collections(texts.withColumnRenamed("value", "_text"), head.drop("_type"))
    return _features(each.select("_source", F.col("_src_index").cast("int").alias("_src_index"), "epsg", F.from_json("_text", _FEATURE).alias("f")))


def _epsg(crs: str | None, named: Column) -> Column:
    if crs is None:
        return epsg_of(named)
    code = crs.upper().rpartition(":")[2]
    return F.lit(4326 if code == "CRS84" else int(code))


def read_geojson_lines(spark: SparkSession, path: str, crs: str | None = None) -> DataFrame:
    """The same of files with a feature in each line, which are split over tasks; _src_index is the place of the line's first byte's block and row."""
    raw = spark.read.text(path).where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("_source"), F.monotonically_increasing_id().alias("_src_index"), F.from_json(F.ltrim("value", F.lit("\x1e")), f"crs string, {_FEATURE}").alias("f"))
    return _features(raw.withColumn("epsg", _epsg(crs, F.col("f.crs"))))


def crs_report(features: DataFrame) -> DataFrame:
    """_source, epsg and reprojected of each file of read features."""
    return features.groupBy("_source").agg(F.first("epsg").alias("epsg")).withColumn("reprojected", F.col("epsg") != 4326)


def as_rows(features: DataFrame, columns: list[str]) -> DataFrame:
    """Analytics rows: the properties named, _geometry_type, and _lon and _lat of the mean of all vertices."""
    parts = validation.rings()
    at = geo.vertex_mean(F.flatten(parts))
    names = sanitized(columns)
    return features.select(*(F.col("properties")[c].alias(n) for c, n in zip(columns, names, strict=True)), F.col("geometry.type").alias("_geometry_type"), at.x.alias("_lon"), at.y.alias("_lat"), F.col("_src_index").alias("_pos"))


def read_csv_points(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header as texts, with lon and lat; leading zeros and the like stay."""
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    low = {c.lower().strip(): c for c in raw.columns}
    lat, lon = next((low[n] for n in LAT if n in low), None), next((low[n] for n in LON if n in low), None)
    if lat is None or lon is None:
        raise ValueError("no latitude and longitude columns")
    names = sanitized(raw.columns)
    plain = raw.toDF(*names)
    pick = dict(zip(raw.columns, names, strict=True))
    return plain.withColumn("lon", F.col(pick[lon]).try_cast("double")).withColumn("lat", F.col(pick[lat]).try_cast("double"))


def layer_type(features: DataFrame) -> DataFrame:
    """The one geometry type of a layer, else GEOMETRY; one row."""
    kinds = features.agg(F.collect_set("geometry.type").alias("k"))
    return kinds.select(F.when(F.size("k") == 1, F.get("k", 0)).otherwise(F.lit("GEOMETRY")).alias("geometry_type"))


#: The file of a stored layer that names the size of its cells.
_SIZE = "_cell_size"


def write_layer(points: DataFrame, path: str, cell_size: float = 0.1) -> None:
    """Parquet clustered by grid cell, so that read_layer skips what lies outside of its box; the cells' size is stored with it."""
    points.withColumn("cell", geo.cell(F.col("lon"), F.col("lat"), cell_size)).repartitionByRange("cell", "lon", "lat").sortWithinPartitions("cell").write.mode("overwrite").parquet(path)
    fs, at = file_system(points.sparkSession, f"{path}/{_SIZE}")
    out = fs.create(at, True)
    out.write(bytearray(repr(float(cell_size)).encode()))
    out.close()


def _cell_size(spark: SparkSession, path: str) -> float | None:
    """The size of the cells of a stored layer; None for one that was stored without it."""
    if not exists(spark, f"{path}/{_SIZE}"):
        return None
    # Spark's readers pass over names that begin with _, so the file is read by the file system.
    fs, at = file_system(spark, f"{path}/{_SIZE}")
    stream = fs.open(at)
    try:
        return float(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def read_layer(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """A layer that write_layer wrote, as a whole or within a box (minx, miny, maxx, maxy, edges included).

    The box also bounds the cells, which are sorted, so that row groups of other cells are never read. A layer without
    a stored size of its cells is read as a whole and filtered.
    """
    layer = spark.read.parquet(path)
    cell_size = _cell_size(spark, path) if box is not None else None
    if box is not None and cell_size is None:
        layer = layer.where(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))
    elif box is not None:
        minx, miny, maxx, maxy = (F.lit(float(v)) for v in box)
        low, high = (math.floor(v / cell_size) * 1_000_003 + math.floor(w / cell_size) for v, w in ((box[0], box[1]), (box[2], box[3])))
        layer = layer.where(F.col("cell").between(low, high) & F.col("lon").between(minx, maxx) & F.col("lat").between(miny, maxy))
    return layer.drop("cell")
