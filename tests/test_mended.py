"""Cases in which rows were lost or mixed up once."""

import threading

import pytest
from pyspark.sql import functions as F

from lodestone import scratch
from lodestone.operators import spatial, state, validation
from lodestone.plans import catalog
from lodestone.sources import layers


def test_rows_without_key_are_kept_and_like_no_other(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (4, None), (5, "b")], "pos int, k string")
    got = {r.pos: r.duplicate for r in validation.duplicate_geometries(rows, F.col("k"), "pos").collect()}
    assert got == {1: False, 2: False, 3: True, 4: False, 5: False}
    assert validation.duplicate_geometries(rows.limit(0), F.col("k"), "pos").count() == 0


def test_rows_without_id_get_one_each(spark):
    rows = spark.createDataFrame([(1, 7), (2, None), (3, 7), (4, None)], "pos int, k int")
    got = {r.pos: r.new_id for r in validation.unique_ids(rows, "k", "pos").collect()}
    assert got[1] == "7" and len(set(got.values())) == 4 and all(got[i].startswith("u-") for i in (2, 3, 4))


def test_a_layer_is_read_by_the_cells_it_was_written_with(spark, tmp_path):
    points = spark.createDataFrame([(i, 10 + i / 7, 50 - i / 9) for i in range(60)], "id int, lon double, lat double")
    want = sorted(r.id for r in points.where("lon between 11 and 14 and lat between 45 and 49.5").collect())
    for size in (0.1, 0.2, 3.0):
        layers.write_layer(points, str(tmp_path / "l"), size)
        assert sorted(r.id for r in layers.read_layer(spark, str(tmp_path / "l"), (11, 45, 14, 49.5)).collect()) == want
    points.withColumn("cell", F.lit(1)).write.parquet(str(tmp_path / "old"))  # a layer without the size
    assert sorted(r.id for r in layers.read_layer(spark, str(tmp_path / "old"), (11, 45, 14, 49.5)).collect()) == want


def test_a_radius_of_nothing_finds_equal_places(spark):
    points = spark.createDataFrame([(1, 10.0, 50.0), (2, 10.0, 50.0001), (3, None, 1.0)], "id int, lon double, lat double")
    refs = spark.createDataFrame([("a", 10.0, 50.0)], "ref string, ref_lon double, ref_lat double")
    assert [(r.id, r.distance_m) for r in spatial.within_radius(points, refs, 0).collect()] == [(1, 0.0)]
    with pytest.raises(ValueError):
        spatial.within_radius(points, refs, -1)


def test_scratch_of_another_thread_stays(spark):
    made, go, done = {}, threading.Event(), threading.Event()

    def other():
        with scratch.cleared(spark):
            made["other"] = scratch.written(spark.range(3), "other")
            go.set()
            done.wait(60)
            made["n"] = made["other"].count()

    thread = threading.Thread(target=other)
    thread.start()
    go.wait(60)
    with scratch.cleared(spark):
        path = scratch.scratch(spark, "mine")
        spark.range(2).write.parquet(path)
        with scratch.cleared(spark):
            inner = scratch.scratch(spark, "inner")
            spark.range(1).write.parquet(inner)
        assert scratch.exists(spark, path) and not scratch.exists(spark, inner)
    assert not scratch.exists(spark, path)
    done.set()
    thread.join()
    assert made["n"] == 3


def test_logs_are_searched_in_message_target_and_logger(spark):
    logs = spark.createDataFrame([(1, "MEM", "x", "y", None), (2, "A", "memo", None, None), (3, "A", None, "agents.mem", None), (4, "A", None, None, "http://mem"), (5, "A", None, None, None)], "id int, module string, message string, logger string, target string")
    assert sorted(r.id for r in state.matching_logs(logs, "MEM").collect()) == [2, 3, 4]
    assert sorted(r.id for r in state.matching_logs(logs.drop("target"), "mem").collect()) == [2, 3]


def test_table_functions_without_side_effects_are_let_through(spark):
    for sql in ("select * from stack(2, 1, 2)", "select * from explode(array(1, 2))", "select t.col from (select 1) lateral view explode(array(1)) t as col"):
        catalog.check(spark, sql, set())
    for sql in ("select * from some_udtf(1)", "select * from a.range(3)", "select * from read_files('/etc')"):
        with pytest.raises(ValueError):
            catalog.check(spark, sql, set())
