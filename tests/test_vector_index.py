"""The vector index and the threshold join against numpy over all rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.operators import state, vector_index
from lodestone.operators.vector_index import VectorIndex, pairs_within

SCHEMA = "chunk_id long, embedding array<float>, label int, score double, rank int"


def clusters(n, d, centres, spread, seed):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(centres, d))
    return at[rng.integers(centres, size=n)] + spread * rng.normal(size=(n, d))


def table(spark, x, odd=()):
    rows = [(i, [float(np.float32(c)) for c in v], i % 3, 0.0, 0) for i, v in enumerate(x)]
    return spark.createDataFrame([*rows, *((i, v, 0, 0.0, 0) for i, v in odd)], SCHEMA)


ODD = [(9001, None), (9002, [0.0] * 8), (9003, [1.0, 2.0]), (9004, []), (9005, [float("nan")] * 8), (9006, [1.0] * 7 + [None])]


def plain_top(x, q, k, keep=None):
    x = np.float32(x).astype(float)
    q = np.array(q, float)
    scores = x @ q / np.sqrt((x * x).sum(axis=1) * (q @ q))
    order = [i for i in sorted(range(len(x)), key=lambda i: (-round(scores[i], 12), i)) if keep is None or keep(i)]
    return [(i, scores[i]) for i in order[:k]]


@pytest.mark.parametrize(("n", "spread"), [(600, 0.05), (400, 2.0), (3, 1.0)])
def test_top_is_that_of_a_scan(spark, tmp_path, n, spread):
    x = clusters(n, 8, 12, spread, 1)
    x[n // 2 :: 7] = x[0]  # many equal vectors
    index = VectorIndex.build(table(spark, x, ODD), str(tmp_path / "v"))
    for q in (x[0], x[n - 1], np.arange(8.0)):
        got = [(r.chunk_id, r.score) for r in index.top(list(map(float, q)), 10).collect()]
        want = plain_top(x, q, 10)
        assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([s for _, s in got], [s for _, s in want])
        if spread < 0.1:
            assert index.read[0] < index.read[1] / 2
    got = [r.chunk_id for r in index.top(list(map(float, x[1])), 5, {"label": 2}).collect()]
    assert got == [i for i, _ in plain_top(x, x[1], 5, lambda i: i % 3 == 2)]
    assert index.top([0.0] * 8, 5).count() == index.top([1.0], 5).count() == 0


def test_top_of_each_query_is_that_of_a_scan(spark, tmp_path):
    x = clusters(500, 8, 10, 0.3, 2)
    x[100:260] = x[7]  # a third of all rows is one vector
    index = VectorIndex.build(table(spark, x[:400], ODD), str(tmp_path / "v"))
    more = table(spark, x).where("chunk_id >= 400")
    index.add(more)
    index = VectorIndex(spark, str(tmp_path / "v"))  # as a later session opens it
    queries = spark.createDataFrame([(i, [float(c) for c in x[i]]) for i in range(0, 500, 20)] + [(-1, None), (-2, [0.0] * 8)], "query_id long, vector array<double>")
    got = {}
    for r in index.top_each(queries, 6).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == {i: [j for j, _ in plain_top(x, x[i], 6)] for i in range(0, 500, 20)}
    few = VectorIndex.build(table(spark, x[:4]), str(tmp_path / "few"))
    assert few.top_each(queries.where("query_id = 0"), 6).count() == 4


def test_queries_and_lists_of_any_size_are_compared_by_blocks(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(vector_index, "BLOCK", 16)
    monkeypatch.setattr(vector_index, "NUMBERS", 8 * 16)  # lists go over several blocks, and queries over several parts
    x = clusters(400, 8, 6, 0.3, 5)
    x[50:200] = x[7]
    index = VectorIndex.build(table(spark, x, ODD), str(tmp_path / "v"))
    assert index._blocks(16)[1].max() > 1
    queries = spark.createDataFrame([(i, [float(c) for c in x[i]]) for i in range(0, 400, 5)] + [(-1, None), (-2, [float("nan")] * 8)], "query_id long, vector array<double>")
    found = index.top_each(queries, 4)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == {i: [j for j, _ in plain_top(x, x[i], 4)] for i in range(0, 400, 5)}
    found.explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" not in plan  # rows met queries one pair at a time
    assert plan.count("REPARTITION_BY_NUM") >= 3  # else Spark puts a small table into one task


def test_a_task_holds_few_scores_at_a_time(monkeypatch):
    monkeypatch.setattr(vector_index, "CELLS", 1000)
    x = clusters(200, 8, 4, 0.5, 6)
    x[20:120] = x[3]
    keys = np.random.default_rng(1).permutation(200)
    entries = pa.table({"chunk_id": keys, "_v": pa.array([*np.float32(x[keys])], pa.list_(pa.float32()))})
    queries = pa.table({"vector": pa.array([*np.float32(x[::10]), None], pa.list_(pa.float32())), "_least": [-2.0] * 20 + [-2.0]})
    parts = list(vector_index._nearest_of_block(entries, queries, "chunk_id", "vector", 8, 3))
    assert len(parts) > 2  # rows that are copies count three times only
    got = [(int(q), int(keys[e])) for qs, es, _ in parts for q, e in zip(qs, es, strict=True)]
    assert got == [(i, j) for i in range(20) for j, _ in plain_top(x, np.float32(x[10 * i]), 3)]
    batch = pa.RecordBatch.from_pydict({"a": list(range(25))})
    assert [b.num_rows for b in vector_index.few(iter([batch]), 100)] == [10, 10, 5]


def test_empty_and_unusable_tables(spark, tmp_path):
    for name, rows in (("none", []), ("odd", ODD)):
        index = VectorIndex.build(table(spark, np.zeros((0, 8)), rows), str(tmp_path / name))
        assert index.rows().count() == len(rows)
        assert name == "odd" or index.top([1.0] * 8, 3).count() == 0
    queries = spark.createDataFrame([(1, [1.0] * 8)], "query_id long, vector array<double>")
    assert VectorIndex.build(table(spark, np.zeros((0, 8))), str(tmp_path / "e")).top_each(queries, 3).count() == 0


@pytest.mark.parametrize("threshold", [0.93, 0.3, -0.5])
def test_pairs_within_a_threshold(spark, threshold):
    x = clusters(300, 8, 6, 0.4, 3)
    entries = table(spark, x, ODD).select("chunk_id", F.col("label").cast("string").alias("scope"), F.col("embedding").alias("a"))
    queries = entries.where("chunk_id % 10 = 0").select(F.col("chunk_id").alias("query_id"), "scope", F.col("a").alias("b"))
    got = {(r.query_id, r.chunk_id) for r in pairs_within(entries, queries, ["scope"], threshold, "a", "b").collect()}
    y = np.float32(x).astype(float)
    y /= np.sqrt((y * y).sum(axis=1))[:, None]
    want = {(q, e) for q in range(0, 300, 10) for e in range(300) if q % 3 == e % 3 and y[q] @ y[e] >= threshold}
    assert got == want


def test_cache_lookup_goes_through_bounds(spark):
    entries = spark.createDataFrame([(i, "s", [1.0, i / 1000, 0.0], float(i)) for i in range(40)], "entry_id long, scope string, vector array<double>, ts double")
    queries = spark.createDataFrame([(5, "s", [1.0, 0.0051, 0.0]), (6, "other", [1.0, 0.0, 0.0]), (7, "s", [0.0, 0.0, 1.0])], "query_id long, scope string, vector array<double>")
    assert [(r.query_id, r.entry_id) for r in state.cache_lookup(entries, queries).collect()] == [(5, 5)]
    assert [r.entry_id for r in state.cache_lookup(entries, queries, others=True).collect()] == [6] or [r.entry_id for r in state.cache_lookup(entries, queries, others=True).collect()] == [4]
