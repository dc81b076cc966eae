"""The keyword index: scores after changes are those of a rebuild, and the best are those of all scores."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.errors import AnalysisException

from lodestone.operators import keyword_index
from lodestone.operators.keyword_index import KeywordIndex

SCHEMA = "chunk_id long, text string, term string, length int"


def plain(chunks, query):
    docs = {i: (t or "").split() for i, t in chunks.items()}
    n, mean = len(docs), sum(map(len, docs.values())) / max(len(docs), 1)
    df = Counter(w for d in docs.values() for w in set(d))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(idf.values()) / max(len(idf), 1)
    out = {}
    for i, d in docs.items():
        tf = Counter(d)
        parts = [(idf[w] if idf[w] >= 0 else floor) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(d) / mean)) for w in query.split() if tf[w]]
        if parts:
            out[i] = sum(parts)
    return out


def name(i):
    return f"w{chr(97 + i // 26)}{chr(97 + i % 26)}"


def named(text):
    """word<i> in a text as the i-th word."""
    return re.sub(r"word(\d+)", lambda m: name(int(m[1])), text)


def table(spark, chunks):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in chunks.items()], SCHEMA)


def text(rng, words):
    return " ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=rng.randint(1, 40)))


@pytest.fixture(scope="module")
def words():
    return [name(i) for i in range(60)]


def same(index, chunks, query):
    got = {r.chunk_id: r.score for r in index.scores(query).collect()}
    want = plain(chunks, query)
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)


def test_changes_are_as_a_rebuild(spark, tmp_path, monkeypatch, words):
    monkeypatch.setattr(keyword_index, "FAN_IN", 6)
    monkeypatch.setattr(keyword_index, "BLOCK", 8)
    rng, path = random.Random(1), str(tmp_path / "i")
    chunks = {i: text(rng, words) for i in range(80)} | {80: None, 81: "", 82: named("word1 ") * 3000}
    index = KeywordIndex.build(table(spark, chunks), path)
    query = named("word1 word7 word7 word30 word59 nowhere")
    same(index, chunks, query)
    most = 1
    for step in range(7):
        if step % 2:
            gone = spark.createDataFrame([(i,) for i in (*rng.sample(sorted(chunks), 9), 10_000)], "chunk_id long")
            index = index.delete(gone)
            for r in gone.collect():
                chunks.pop(r.chunk_id, None)
        else:
            new = {i: text(rng, words) for i in rng.sample(range(140), 15)}  # some are there already, or were
            index = index.put(table(spark, new))
            chunks |= new
        most = max(most, len(index.segments))
        index = KeywordIndex(spark, path)  # as a later session opens it
        same(index, chunks, query)
        assert (index.n, index.words) == (len(chunks), sum(len((t or "").split()) for t in chunks.values()))
        best = [(r.chunk_id, r.score) for r in index.top(query, 7).collect()]
        want = sorted(plain(chunks, query).items(), key=lambda x: (-round(x[1], 9), x[0]))[:7]
        assert [i for i, _ in best] == [i for i, _ in want]
    assert 2 < most < 6 and len(index.segments) < most + 1  # segments were merged meanwhile
    same(index.compact(), chunks, query)
    assert len(KeywordIndex(spark, path).segments) == 1


def test_best_are_found_without_reading_all_blocks(spark, tmp_path, monkeypatch, words):
    monkeypatch.setattr(keyword_index, "BLOCK", 10)
    monkeypatch.setattr(keyword_index, "FIRST_BLOCKS", 8)
    rng = random.Random(2)
    chunks = {i: text(rng, words) for i in range(1500)}
    index = KeywordIndex.build(table(spark, chunks), str(tmp_path / "i"))
    for most, query in ((1000, "word40 word50 word51"), (3, "word40 word50 word51"), (1000, "word0"), (1000, "word1 word2 word55 word55")):
        query = named(query)
        monkeypatch.setattr(keyword_index, "NAMED_BLOCKS", most)
        got = [(r.chunk_id, r.score) for r in index.top(query, 5).collect()]
        want = sorted(plain(chunks, query).items(), key=lambda x: (-round(x[1], 9), x[0]))[:5]
        assert [i for i, _ in got] == [i for i, _ in want] and all(s == pytest.approx(x) for (_, s), (_, x) in zip(got, want, strict=True))
        if named("word50") in query:
            assert index.read[0] < index.read[1]
    few = table(spark, {i: "" for i in range(0, 1500, 50)})
    want = [i for i, _ in sorted(plain(chunks, named("word9")).items(), key=lambda x: (-round(x[1], 9), x[0])) if i % 50 == 0]
    assert [r.chunk_id for r in index.top(named("word9"), 100, few).collect()] == want


def test_a_new_index_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "i")
    KeywordIndex.build(table(spark, {1: "alpha", 2: "beta"}), path)
    monkeypatch.setattr(KeywordIndex, "_committed", lambda self, segment: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        KeywordIndex.build(table(spark, {1: "gamma"}), path)
    with pytest.raises(ZeroDivisionError):
        KeywordIndex(spark, path).put(table(spark, {3: "gamma"}))
    monkeypatch.undo()
    assert [r.chunk_id for r in KeywordIndex(spark, path).scores("alpha gamma").collect()] == [1]
    KeywordIndex.build(table(spark, {1: "gamma"}), path)
    assert [r.chunk_id for r in KeywordIndex(spark, path).scores("alpha gamma").collect()] == [1] and KeywordIndex(spark, path).n == 1


def test_empty_indexes(spark, tmp_path):
    index = KeywordIndex(spark, str(tmp_path / "none"))
    assert index.scores("a").count() == index.top("a", 3).count() == 0
    index = KeywordIndex.build(table(spark, {}), str(tmp_path / "e"))
    assert index.scores("a").count() == 0
    gone = index.delete(spark.createDataFrame([(1,)], "chunk_id long"))
    with pytest.raises(AnalysisException):  # by a writer that has not seen the last commit
        index.put(table(spark, {5: "a b"}))
    index = gone
    assert index.n == 0
    index = index.put(table(spark, {5: "a b", 6: None}))
    assert index.n == 2 and [r.chunk_id for r in index.top("a", 3).collect()] == [5]
    assert index.delete(spark.createDataFrame([(5,), (6,)], "chunk_id long")).scores("a").count() == 0
