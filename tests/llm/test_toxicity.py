"""The toxicity operator: the kernel by its definition, the folded machine by all landmarks, and held-out texts."""

import random
import zlib

import numpy as np
import pytest

from lodestone.llm import toxicity

SCHEMA = "doc_id long, text string, label int, score double, piece string"
WORDS = [f"{a}{b}{c}" for a in ("ba", "ne", "ki", "sto", "ru") for b in ("lan", "mer", "tin", "do") for c in ("ed", "ing", "os", "")]
BAD = ["blockhead", "numbskull", "dimwit"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng, rows, labels = random.Random(1), [], []
    for i in range(400):
        words = [rng.choice(WORDS) for _ in range(40)]
        toxic = i % 5 == 0
        for _ in range(rng.randint(1, 3) if toxic else 0):
            words[rng.randrange(40)] = rng.choice(BAD)
        rows.append((i, " ".join(words[:20]) + ". " + " ".join(words[20:]) + ".", 7, 0.5, "p"))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def model(spark, corpus):
    return toxicity.train(toxicity.labelled_texts(*corpus))


def test_kernel_by_its_definition():
    rng = random.Random(2)
    words = ["^" + "".join(rng.choice("abcé語") for _ in range(rng.randint(1, 14))) + "$" for _ in range(60)] + ["^$", "^a$", "^aaaaaaaaaaaaaaaa$"]
    marks = toxicity.Landmarks(words[:40])
    got = marks.similar(words)
    assert np.allclose(got, [[toxicity.kernel(a, b) for b in words[:40]] for a in words])
    mapped = marks.mapped(words[:40])
    assert np.allclose(mapped @ mapped.T, got[:40], atol=1e-4)  # among landmarks the map of Nyström gives the kernel
    w, bias = np.random.default_rng(3).normal(size=mapped.shape[1]), 0.3
    machine = toxicity.Machine(marks.alphabet, marks.index, marks.folded(w), bias)
    assert np.allclose(machine.pieces(words), np.clip(marks.mapped(words) @ w + bias, toxicity.FLOOR, toxicity.CEILING))
    low = toxicity.Machine(marks.alphabet, marks.index, marks.folded(w), -1.0)
    assert np.allclose(low.pieces(words), np.clip(marks.mapped(words) @ w - 1.0, toxicity.FLOOR, toxicity.CEILING))


def test_svm_is_at_the_least_loss():
    rng = np.random.default_rng(4)
    x, y, weight = rng.normal(size=(200, 3)), np.where(rng.random(200) < 0.5, 1.0, -1.0), rng.random(200)
    w, b = toxicity.svm(x, y, weight)
    loss = lambda w, b: 0.5 * w @ w + 4 * (weight * np.maximum(1 - y * (x @ w + b), 0) ** 2).sum()
    assert all(loss(w, b) <= loss(w + d[:3], b + d[3]) + 1e-9 for d in rng.normal(size=(50, 4)) * 0.01)


def test_held_out_texts(corpus):
    got = toxicity.toxicity(*corpus).collect()
    assert len(got) == 400
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.predicted == int(r.doc_id % 5 == 0)


def test_labels_of_held_out_rows_are_not_learned(spark, corpus):
    docs, labels = corpus
    turned = labels.selectExpr("doc_id", "quality", "case when pmod(crc32(cast(string(doc_id) as binary)), 5) = 0 then 1 - toxic else toxic end as toxic")
    assert sorted(toxicity.toxicity(docs, turned).collect()) == sorted(toxicity.toxicity(docs, labels).collect())


def test_gaps_and_inserted_characters(spark, model):
    texts = ["blockhead", "b.l.o.c.k.h.e.a.d", "b l o c k h e a d", "BLOCK*HEAD", "blockxhead", "blckhead", "num8bskull", "NUMB-SKULL!!", "numbsskull", "dim_wit", "dimxwit", "d i m w i t"]
    rows = [(i, f"balaned nemering {t} kitinos ruland.", 0, 0.0, "") for i, t in enumerate(texts)]
    clean = [(100 + i, f"balaned nemering {t} kitinos ruland.", 0, 0.0, "") for i, t in enumerate([*WORDS, "skill", "witness", "", "a b c d"])]
    got = {r.doc_id: r.score for r in toxicity.scored(spark.createDataFrame(rows + clean, SCHEMA), model).collect()}
    assert all(got[i] >= 0.5 for i in range(len(texts))), [(t, got[i]) for i, t in enumerate(texts)]
    assert all(s < 0.5 for i, s in got.items() if i >= 100)


def test_sentences(spark, model):
    text = "Balaned kitin here. You are a Block-Head! Ruland stoland\nnemering dimwit."
    got = sorted(toxicity.toxic_sentences(spark.createDataFrame([(1, text, 0, 0.0, ""), (2, None, 0, 0.0, ""), (3, "balaned.", 0, 0.0, "")], SCHEMA), model).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.sentence, r.word) for r in got] == [(1, "You are a Block-Head!", "block-head!"), (1, "nemering dimwit.", "dimwit.")]
    assert all(text[r.start :].startswith(r.sentence) for r in got)


def test_odd_rows_and_tables(spark, corpus, model):
    docs, labels = corpus
    odd = [(None, "blockhead", 1, 0.0, ""), (1, None, 1, 0.0, ""), (2, "", 1, 0.0, ""), (3, " \n ", 1, 0.0, ""), (3, " \n ", 1, 0.0, ""), (4, "x" * 100_000, 1, 0.0, ""), (5, "balaned " * 50_000 + "blockhead", 1, 0.0, ""), (6, "日本語 ^ $ \U0010ffff", 1, 0.0, "")]
    rows = spark.createDataFrame(odd, SCHEMA)
    got = toxicity.toxicity(docs.unionByName(rows), labels.union(spark.createDataFrame([(None, 1, 1), (7, 1, None), (0, 1, 1)], labels.schema)))
    assert got.count() == 408 and {r.held_out for r in got.where("doc_id is null").collect()} == {False}
    by = [(r.doc_id, r.score) for r in toxicity.scored(rows, model).collect()]
    assert [s >= 0.5 for _, s in by] == [True, False, False, False, False, False, True, False] and by[3] == by[4]
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.toxicity(rows, labels.limit(0)).collect()} == {0.5}
    assert toxicity.toxicity(docs, labels.withColumn("toxic", labels.quality)).where("predicted = 0").count() == 0  # one label only
    broken = spark.sql("select 1L as doc_id, cast(unhex('626C6F636B68656164FF') as string) as text")
    assert toxicity.scored(broken, model).first().score >= 0.5


def test_training_rows_are_bounded(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    got = toxicity.labelled_texts(docs, labels, rows=20)
    assert got.count() == 20 and {r.label for r in got.collect()} == {1}


def test_workers_forget(spark, corpus, model, monkeypatch):
    monkeypatch.setattr(toxicity, "SEEN", 10)
    reader = toxicity.Reader(model.machine)
    for _ in range(3):
        words = toxicity.words_of("balaned blockhead " + " ".join(WORDS))
        reader.learn([words])
        assert reader.top(words)[0][1] == "blockhead"
