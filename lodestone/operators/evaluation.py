"""Scores of answers against their question and context, the gate that they pass, and what a model is shown.

Judges are hooks: each is a function of whole columns, given a batch of rows in each task. Where there is none, or
where it fails, the lexical form takes its place if there is one, else the score stays null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import content_tokens, overlap, round_half_even
from lodestone.operators.guardrails import output_reasons

# The least faithfulness of an answer, characters of history and of context that a model is shown, and of
# context where a question asks for all there is.
LEAST_FAITHFUL, HISTORY_CHARS, CONTEXT_CHARS, FULL_CONTEXT_CHARS = 0.5, 4000, 7000, 16000
# What is said in place of an answer.
UNVERIFIED = "I found the source but couldn't verify a specific, reliable answer to that in it, so I won't guess."
REFUSAL = "I couldn't find enough reliable information in the available documents or official sources to answer that accurately."
#: Share of a claim's content words that the context has to have for the lexical judge.
SUPPORT = 0.6


def clamped(score: Column) -> Column:
    """A judge's score between 0 and 1; null where it is none."""
    value = score.cast("double")
    return F.when(value.isNotNull() & ~F.isnan(value), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def claims_of(answer: Column) -> Column:
    """The sentences of an answer that have a content word."""
    return F.filter(F.split(F.coalesce(answer, F.lit("")), r"(?<=[.!?؟])\s+|\n"), lambda c: F.size(content_tokens(c)) > 0)


def supported_claims(answer: Column, context: Column, least: float = SUPPORT) -> Column:
    """(claim, supported) of each claim: whether the context has so large a share of its content words."""
    return F.transform(claims_of(answer), lambda c: F.struct(c.alias("claim"), (overlap(c, context) >= least).alias("supported")))


def supported_share(claims: Column) -> Column:
    """The share of claims that are supported; null without any."""
    return F.when(F.size(claims) > 0, F.size(F.filter(claims, lambda c: c.supported)) / F.size(claims))


def judged(judge: Callable[[pd.Series, pd.Series], list[float]], a: Column, b: Column) -> Column:
    """The clamped scores of a judge over two text columns, a batch at a time; null for batches in which it fails."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            try:
                yield pd.Series(list(judge(x, y)), index=x.index, dtype="float64")
            except Exception:  # the judge is an extra
                yield pd.Series([None] * len(x), index=x.index, dtype="float64")

    return clamped(run(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))


def evaluated(answers: DataFrame, relevancy: Callable | None = None, context: Callable | None = None, faithfulness: Callable | str | None = None, enabled: bool = True) -> DataFrame:
    """answers (question, answer, context, found) with answer_relevancy, context_relevancy, faithfulness and claims.

    The judges are functions of (question, answer), (question, context) and (answer, context). Relevancy falls back to
    the share of the question's content words that the answer has. faithfulness may be "lexical": then claims and
    their support are worked out here. Nothing is scored where the answer is empty or not found, and nothing that
    needs a context where that is blank.
    """
    scored = F.lit(enabled) & F.coalesce("found", F.lit(True)) & (F.coalesce("answer", F.lit("")) != "")
    grounded = scored & (F.trim(F.coalesce("context", F.lit(""))) != "")
    lexical = round_half_even(overlap(F.col("question"), F.col("answer")), 4)
    first = F.coalesce(judged(relevancy, F.col("question"), F.col("answer")), lexical) if relevancy else lexical
    second = judged(context, F.col("question"), F.col("context")) if context else F.lit(None).cast("double")
    claims = supported_claims(F.col("answer"), F.col("context")) if faithfulness == "lexical" else F.array().cast("array<struct<claim:string,supported:boolean>>")
    out = answers.withColumn("answer_relevancy", F.when(scored, first)).withColumn("context_relevancy", F.when(grounded, second)).withColumn("claims", F.when(grounded, claims))
    third = supported_share(F.col("claims")) if faithfulness == "lexical" else judged(faithfulness, F.col("answer"), F.col("context")) if faithfulness else F.lit(None).cast("double")
    return out.withColumn("faithfulness", F.when(grounded, third))


def gated(answers: DataFrame, least: float = LEAST_FAITHFUL) -> DataFrame:
    """answers with answer, found, valid and reasons after the gate.

    Columns: answer, faithfulness, n_sources, and derived, true for counts and full lists, whose values stand in no
    sentence of the source and pass the first test. An answer of too little faithfulness, then one that the output
    check has reasons against, gives way to a sentence that says so; an unknown faithfulness is no reason.
    """
    low = ~F.coalesce("derived", F.lit(False)) & F.coalesce(F.col("faithfulness") < least, F.lit(False))
    reasons = output_reasons(F.col("answer"), F.col("n_sources"), F.lit(True))
    marked = answers.withColumns({"_low": low, "_reasons": reasons})
    bad = F.size("_reasons") > 0
    return marked.withColumns({
        "answer": F.when(F.col("_low"), UNVERIFIED).when(bad, REFUSAL).otherwise(F.col("answer")),
        "found": ~F.col("_low") & ~bad,
        "valid": F.col("_low") | ~bad,
        "reasons": F.when(F.col("_low"), F.array(F.lit("low_faithfulness"))).otherwise(F.col("_reasons")),
    }).drop("_low", "_reasons")


def with_history(context: Column, history: Column) -> Column:
    """The context after the conversation so far, of which the first HISTORY_CHARS characters are shown."""
    told = F.concat(F.lit("Conversation so far:\n"), F.left(history, F.lit(HISTORY_CHARS)))
    body = F.coalesce(context, F.lit(""))
    return F.when(F.coalesce(history, F.lit("")) == "", body).when(body == "", told).otherwise(F.concat(told, F.lit("\n\n---\n"), body))


def shown_context(context: Column, exhaustive: Column | None = None) -> Column:
    """As much of a context as a model is shown: more for questions about all there is."""
    chars = F.lit(CONTEXT_CHARS) if exhaustive is None else F.when(exhaustive, FULL_CONTEXT_CHARS).otherwise(CONTEXT_CHARS)
    return F.left(F.coalesce(context, F.lit("")), chars)


def hit_shape(hits: DataFrame) -> DataFrame:
    """hits (text, score and metadata) as text, source (else the title), score, metadata (a struct) and key.

    The key is the chunk_id, or where there is none a hash of the text, so that lists of hits can be merged.
    """
    has = lambda c: F.col(c).cast("string") if c in hits.columns else F.lit(None).cast("string")
    filled = lambda c: F.when(has(c) != "", has(c))
    more = [c for c in hits.columns if c not in ("text", "score")]
    return hits.select(
        F.coalesce("text", F.lit("")).alias("text"), F.coalesce(filled("source"), has("title"), F.lit("")).alias("source"), F.col("score").cast("double").alias("score"),
        (F.struct(*more) if more else F.lit(None)).alias("metadata"), F.coalesce(filled("chunk_id"), F.substring(F.sha1(F.coalesce("text", F.lit(""))), 1, 16)).alias("key"),
    )
