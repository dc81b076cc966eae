"""Steps that held more in one process than they had to."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.operators import chunking, keyword_index, vector_index
from lodestone.sources import documents


def test_terms_are_counted_without_python(spark, capsys):
    texts = ["b a b c b a", "", None, "X x 12 12 x"]
    rows = keyword_index.counted(spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string"))
    got = {r.chunk_id: (r.length, dict(zip(r.terms, r.tf, strict=True))) for r in rows.collect()}
    assert got == {0: (6, {"a": 2, "b": 3, "c": 1}), 1: (0, {}), 2: (0, {}), 3: (5, {"x": 3, "12": 2})}
    rows.explain()
    assert "InArrow" not in capsys.readouterr().out


def test_the_driver_is_given_about_the_sample(spark, monkeypatch):
    vectors = spark.range(0, 4000, 1, 8).select(F.array(F.cos("id"), F.sin("id"), F.lit(1.0)).alias("v"))
    given, real = [], vector_index.directions
    monkeypatch.setattr(vector_index, "directions", lambda c, n=None: given.append(len(c)) or real(c, n))
    ordered = []
    monkeypatch.setattr(type(vectors), "orderBy", lambda *a, **k: ordered.append(1))  # a top of so many from each task
    assert len(vector_index.centres_of(vectors, "v", 16, sample=400)) == 16
    assert not ordered and 300 < given[0] < 500


def test_directions_leave_out_what_has_none():
    column = pa.array([[3.0, 4.0], None, [0.0, 0.0], [1.0], [None, 1.0], [float("inf"), 1.0], [0.0, 2.0]], pa.list_(pa.float32()))
    x, good = vector_index.directions(column, 2)
    assert good.tolist() == [True, False, False, False, False, False, True] and np.allclose(x[[0, 6]], [[0.6, 0.8], [0, 1]])
    assert np.array_equal(vector_index.directions(column.slice(6), 2)[0], [[0, 1]])


def test_rows_of_long_work_are_dealt_out_however_large_the_table(spark):
    rows = spark.range(0, 1000, 1, 2)
    cores = spark.sparkContext.defaultParallelism
    assert documents.spread(rows, 10).rdd.getNumPartitions() == max(cores, 100)
    assert documents.spread(rows).rdd.getNumPartitions() == max(cores, 2)


def test_pieces_are_given_back_by_few_texts(spark, monkeypatch):
    monkeypatch.setattr(chunking, "ROWS", 3)
    docs = spark.range(0, 20, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), (F.col("id") % 4).cast("int")).alias("text"))
    assert sorted((r.doc_id, r.chunk_index, r.text) for r in chunking.recursive_chunks(docs).collect()) == [(i, 0, " ".join(["word"] * (i % 4))) for i in range(20) if i % 4]


def test_only_the_nearest_of_a_block_come_out(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK", 16)
    entries = spark.range(90).select(F.col("id").alias("e"), (F.col("id") % 3).alias("scope"), F.array(F.cos(F.col("id") / 60), F.sin(F.col("id") / 60)).alias("a"))
    queries = entries.where("e % 5 = 0").select(F.col("e").alias("q"), "scope", F.col("a").alias("b"))
    rows = vector_index.pairs_within(entries, queries, ["scope"], 0.5, "a", "b", nearest=True, but=("e", "q")).collect()
    best = {}
    for r in rows:
        best[r.q] = max(best.get(r.q, (0, 0)), (round(r.score, 9), -r.e))
    assert {q: abs(q + e) for q, (_, e) in best.items()} == dict.fromkeys(range(0, 90, 5), 3)
    assert len(rows) < 18 * 12  # not the 29 others of a scope
