"""Bounds on what training brings to the driver, and commits of writers that died."""

import threading

import pytest
from pyspark.sql import functions as F

from lodestone.llm import quality, token_rollup



@pytest.fixture(scope="module")
def row(spark):
    return spark.createDataFrame([(1, "s", "en", "t")], "doc_id long, source string, lang string, text string")


def test_training_rows_are_bounded_whatever_repeats(spark, monkeypatch):
    seen, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, y: (seen.append(len(x)), fit(x, y))[1])
    docs = spark.createDataFrame([(1, f"text {i % 900}") for i in range(2000)] + [(2, "other words"), (None, "no id"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (None, 1)], "doc_id long, quality int")
    quality.train(docs, labels, rows=50)
    quality.train(docs, labels)
    quality.train(docs, labels, rows=1)
    assert seen == [50, 902, 1]
    a, b = (quality.train(d, labels) for d in (docs, docs.repartition(5)))
    assert a.start == b.start and all((x == y).all() for x, y in zip(a.tables, b.tables, strict=True))


def test_an_empty_commit_is_passed_over(spark, row, tmp_path):
    """As a writer leaves it that died between making the file and writing it."""
    path = str(tmp_path / "r")
    rollup = token_rollup.TokenRollup(spark, path)
    rollup.commit("a", token_rollup.inserts(row, {"v1": F.lit(3)}))
    (tmp_path / "r" / "v1.commit").touch()
    again = token_rollup.TokenRollup(spark, path)
    assert again.version == 0 and again.totals().first().n_tokens == 3
    assert rollup.commit("b", token_rollup.inserts(row, {"v1": F.lit(3)})) and rollup.version == 2
    assert token_rollup.TokenRollup(spark, path).totals().first().n_tokens == 6
    assert not [p for p in (tmp_path / "r").iterdir() if p.name.startswith("_")]
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "v0.commit").touch()
    first = token_rollup.TokenRollup(spark, str(tmp_path / "e"))
    assert first.version == -1 and first.commit("a", token_rollup.inserts(row, {"v1": F.lit(3)})) and first.totals().first().n_tokens == 3


def test_writers_at_the_same_time_lose_nothing(spark, row, tmp_path):
    path, errors = str(tmp_path / "r"), []

    def write(name):
        try:
            token_rollup.TokenRollup(spark, path).commit(name, token_rollup.inserts(row, {"v1": F.lit(3)}))
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(f"batch {i}",)) for i in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and token_rollup.TokenRollup(spark, path).totals().first().n_docs == 3
