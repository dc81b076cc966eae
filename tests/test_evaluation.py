"""Scores of answers, the gate, windows of what a model is shown, and exact rounding."""

import random
import struct

from pyspark.sql import functions as F

from lodestone.functions.text import round_half_even
from lodestone.operators import evaluation

SCHEMA = "id int, question string, answer string, context string, found boolean"
ROWS = [
    (1, "Where is the old museum?", "The museum stands near the river. It opened in spring.", "An old museum stands near the river.", True),
    (2, "Where is the old museum?", "", "text", True), (3, "x", "y z", "  ", True), (4, "Where?", "some words", "some words", False), (5, None, None, None, None), (6, "the of", "Museum hours", "museum hours", True),
]


def test_lexical_scores(spark):
    got = {r.id: r for r in evaluation.evaluated(spark.createDataFrame(ROWS, SCHEMA), faithfulness="lexical").collect()}
    assert (got[1].answer_relevancy, got[1].faithfulness, got[1].context_relevancy) == (0.5, 0.5, None)
    assert [(c.claim, c.supported) for c in got[1].claims] == [("The museum stands near the river.", True), ("It opened in spring.", False)]
    assert all(got[i].answer_relevancy is None and got[i].faithfulness is None for i in (2, 4, 5))
    assert got[3].answer_relevancy == 0 and got[3].faithfulness is None and got[6].answer_relevancy == 0 and got[6].faithfulness == 1
    assert all(r.answer_relevancy is None for r in evaluation.evaluated(spark.createDataFrame(ROWS, SCHEMA), enabled=False).collect())


def test_judges_are_clamped_and_may_fail(spark):
    rows = spark.createDataFrame(ROWS[:1], SCHEMA)
    r = evaluation.evaluated(rows, lambda q, a: [1.7] * len(q), lambda q, c: [-2] * len(q), lambda a, c: [0.25] * len(a)).first()
    assert (r.answer_relevancy, r.context_relevancy, r.faithfulness) == (1.0, 0.0, 0.25)
    r = evaluation.evaluated(rows, lambda q, a: 1 / 0, lambda q, c: ["no"], lambda a, c: 1 / 0).first()
    assert (r.answer_relevancy, r.context_relevancy, r.faithfulness) == (0.5, None, None)


def test_gate(spark):
    rows = [(1, "fine", 0.9, 1, False), (2, "low", 0.49, 1, False), (3, "derived", 0.1, 1, True), (4, "no source", 0.9, 0, False), (5, "unknown", None, 2, None), (6, "edge", 0.5, 1, False)]
    got = {r.id: r for r in evaluation.gated(spark.createDataFrame(rows, "id int, answer string, faithfulness double, n_sources int, derived boolean")).collect()}
    assert [got[i].found for i in range(1, 7)] == [True, False, True, False, True, True]
    assert (got[2].answer, got[2].reasons, got[2].valid) == (evaluation.UNVERIFIED, ["low_faithfulness"], True)
    assert (got[4].answer, got[4].reasons, got[4].valid) == (evaluation.REFUSAL, ["no_citations"], False) and got[5].answer == "unknown"


def test_windows_of_context(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    lit = lambda x: F.lit(x).cast("string")
    assert one(evaluation.with_history(lit("c"), lit(None))) == "c" == one(evaluation.with_history(lit("c"), lit("")))
    assert one(evaluation.with_history(lit(""), lit("h" * 5000))) == "Conversation so far:\n" + "h" * 4000
    assert one(evaluation.with_history(lit("c"), lit("h"))) == "Conversation so far:\nh\n\n---\nc"
    assert [len(one(evaluation.shown_context(lit("x" * 20_000), e))) for e in (None, F.lit(True), F.lit(False))] == [7000, 16000, 7000]


def test_hit_shape(spark):
    hits = spark.createDataFrame([("t", 0.5, "c1", "s", "title", 3), (None, 0.25, None, "", "title", None), ("t", 0.1, "", None, None, 1)], "text string, score float, chunk_id string, source string, title string, page int")
    got = evaluation.hit_shape(hits).collect()
    assert [(r.text, r.source, r.score) for r in got] == [("t", "s", 0.5), ("", "title", 0.25), ("t", "", 0.10000000149011612)]
    assert got[0].key == "c1" and len(got[1].key) == len(got[2].key) == 16 and got[1].key != got[2].key and got[0].metadata.asDict() == {"chunk_id": "c1", "source": "s", "title": "title", "page": 3}
    assert evaluation.hit_shape(spark.createDataFrame([("t", 1.0)], "text string, score double")).first().source == ""


def test_rounding_is_that_of_the_exact_value(spark):
    rng = random.Random(5)
    values = [2.675, 0.125, 0.375, 1.00005, 0.00005, 2.5, -2.5, -0.125, 1e15 + 0.3, 1e300, 0.0, -0.0, 5e-324, 123456.00005, 450359962737.0495, 900719925474.0993]
    values += [rng.uniform(-1000, 1000) for _ in range(2000)] + [rng.randint(-(10**9), 10**9) / 10**rng.randint(0, 9) for _ in range(3000)] + [(2 * rng.randint(0, 10**6) + 1) / 2**rng.randint(1, 12) for _ in range(2000)]
    for x in list(values[:5000]):  # the doubles on either side of a tie
        bits = struct.unpack("<q", struct.pack("<d", round(x, 3) + 0.00005))[0]
        values += [struct.unpack("<d", struct.pack("<q", bits + d))[0] for d in (-1, 0, 1)]
    values += [float("inf"), float("-inf"), None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    for digits in (0, 2, 4):
        got = [r[0] for r in rows.orderBy("i").select(round_half_even(F.col("x"), digits)).collect()]
        assert [(v, g) for v, g in zip(values, got, strict=True) if v is not None and g != (v if v in (float("inf"), float("-inf")) else round(v, digits))] == [] and got[-1] is None
