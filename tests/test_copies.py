"""Joins of many rows at few places: what meets is tested once for each pair of places, and every pair of rows comes out."""

import math

import pytest
from pyspark.sql import functions as F

from lodestone.functions import geo
from lodestone.operators import spatial


@pytest.fixture
def sides(spark):
    places = [(10.0, 50.0), (10.01, 50.0), (12.0, 51.0)]
    points = spark.createDataFrame([(i, "p", *places[i % 3]) for i in range(45)] + [(99, "p", None, 1.0)], "id int, name string, lon double, lat double")
    refs = spark.createDataFrame([(i, "r", *places[i % 2]) for i in range(30)], "ref int, name string, ref_lon double, ref_lat double")
    return points, refs


@pytest.fixture
def counted(spark, monkeypatch):
    """Counts the rows that a test of geometries is made on."""
    def count(name, kind):
        real, seen = getattr(geo, name), spark.sparkContext.accumulator(0)

        def one(x):
            seen.add(1)
            return x

        monkeypatch.setattr(geo, name, lambda *a: F.udf(one, kind)(real(*a)))
        return seen

    return count


def test_a_distance_is_taken_once_for_each_pair_of_places(sides, counted, monkeypatch):
    seen = counted("haversine", "double")
    monkeypatch.setattr(spatial, "UNIT", 4)
    got = spatial.within_radius(*sides, 1000)
    assert got.columns == ["id", "name", "lon", "lat", "ref", "name", "ref_lon", "ref_lat", "distance_m"]
    rows = [(r.id, r.ref) for r in got.select("id", "ref").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {(i, j) for i in range(45) for j in range(30) if i % 3 < 2}
    assert seen.value <= 3 * 2 * 3  # not 45 * 30


def test_boxes_are_counted_without_pairs(sides, monkeypatch):
    points, refs = sides
    monkeypatch.setattr(spatial, "UNIT", 4)
    boxes = refs.select("ref", (F.col("ref_lon") - 0.005).alias("minx"), (F.col("ref_lat") - 1).alias("miny"), (F.col("ref_lon") + 0.005).alias("maxx"), (F.col("ref_lat") + 1).alias("maxy"))
    assert {(r.ref, r.n) for r in spatial.box_counts(points, boxes, 0.05).collect()} == {(i, 15) for i in range(30)}
    assert sorted((r.id, r.ref) for r in spatial.box_join(points, boxes, 0.05).collect()) == sorted((i, j) for i in range(45) for j in range(30) if i % 3 == j % 2)


def test_the_nearest_of_one_place_are_found_once(sides, counted):
    seen = counted("haversine", "double")
    got = {(r.ref, r["rank"], r.id) for r in spatial.nearest_each(*sides, 4, "id", "ref").collect()}
    assert got == {(j, n, 3 * (n - 1) + j % 2) for j in range(30) for n in range(1, 5)}
    assert seen.value <= 3 * 4 * 2 * 3


@pytest.mark.parametrize("unit", [4, 256])
def test_equal_shapes_are_tested_as_one(sides, monkeypatch, unit):
    joins, real = [], spatial._met
    monkeypatch.setattr(spatial, "_met", lambda *a: joins.append(real(*a)) or joins[-1])
    monkeypatch.setattr(spatial, "UNIT", unit)
    points, refs = sides
    corners = [(F.col("ref_lon") + 0.005 * math.cos(t), F.col("ref_lat") + 0.005 * math.sin(t)) for t in (0, 2, 4)]
    shapes = refs.select("ref", F.array(F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in corners))).alias("rings"))
    assert sorted((r.id, r.ref) for r in spatial.polygon_join(points, shapes).collect()) == sorted((i, j) for i in range(45) for j in range(30) if i % 3 == j % 2)
    assert joins.pop(0).count() <= 3 * 2
    joins.clear()
    pairs = [(r.a, r.b) for r in spatial.layers_meet(shapes.withColumnRenamed("ref", "a"), shapes.withColumnRenamed("ref", "b"), "a", "b").collect()]
    assert sorted(pairs) == sorted((i, j) for i in range(30) for j in range(30) if (i - j) % 2 == 0)
    assert joins.pop(0).select("_ahash", "_bhash").distinct().count() <= 4


def test_a_point_on_a_shared_edge_is_in_one_of_two_areas(spark):
    points = spark.createDataFrame([(1, 1.0, 0.5), (2, 0.0, 0.5), (3, 2.0, 0.5), (4, 0.5, 0.5)], "id int, lon double, lat double")
    areas = [[(x, 0.0), (x + 1, 0.0), (x + 1, 1.0), (x, 1.0)] for x in (0.0, 1.0)]
    found = [sorted(r.id for r in spatial.search_layers({"l": points}, [a], "half_open").collect()) for a in areas]
    assert found == [[2, 4], [1]]
