"""Keyed state as tables: result cache, conversations, logs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import token_estimate
from lodestone.operators.retrieval import latest
from lodestone.operators.vector_index import pairs_within

# The least cosine of a hit, entries kept, tokens and turns of a window.
THRESHOLD, ENTRIES, BUDGET, TURNS = 0.93, 512, 2000, 5
# Tags of loggers by their last name.
MODULES = {
    "intent_router": "AGENT_ROUTER", "knowledge_pipeline": "RAG_RETRIEVAL", "hybrid_retriever": "RAG_RETRIEVAL", "vector_store": "RAG_RETRIEVAL", "retrieval_validator": "RAG_RETRIEVAL",
    "evaluation": "RAG_RETRIEVAL", "embeddings": "EMBEDDINGS", "web_fallback": "WEB_FETCH", "llm_client": "LLM_CALL", "column_describer": "LLM_CALL", "routing": "ROUTING",
    "spatial_search": "POSTGIS_QUERY", "dataset_lookup": "POSTGIS_QUERY", "geojson_validator": "VALIDATION", "document_loader": "INGEST", "chunker": "INGEST", "doc_ingest": "INGEST",
    "semantic_cache": "CACHE", "memory": "MEMORY", "guardrails": "GUARDRAILS", "api": "API",
}


def scope_key(ids: Column, collection: Column) -> Column:
    return F.concat_ws("|", F.array_join(F.array_sort(F.array_distinct(ids)), ","), collection)


def cache_lookup(entries: DataFrame, queries: DataFrame, now: float | None = None, ttl: float = 0.0, threshold: float = THRESHOLD, others: bool = False) -> DataFrame:
    """For each query (query_id, scope, vector) the best fresh entry (entry_id, scope, vector, ts) of its scope.

    With others, a query leaves out the entry of its own id. A query meets all entries of its scope, however many, in
    blocks of both; ties go to the older entry.
    """
    fresh = entries if not ttl or now is None else entries.where(F.col("ts") >= now - ttl)
    pairs = pairs_within(fresh.withColumnRenamed("vector", "_v"), queries, ["scope"], threshold, "_v", "vector", nearest=True, but=("entry_id", "query_id") if others else None)
    pairs = pairs.where(F.col("entry_id") != F.col("query_id")) if others else pairs
    order = F.struct("score", -F.col("ts"), -F.col("entry_id"))
    best = pairs.groupBy("query_id").agg(F.max_by(F.struct("entry_id", "score"), order).alias("b"))
    return best.select("query_id", "b.entry_id", "b.score")


def cache_put(entries: DataFrame, new: DataFrame, keep: int = ENTRIES) -> DataFrame:
    """The entries with new ones added, one of a known entry_id in its place, and the oldest of each scope dropped."""
    return cache_trimmed(latest(entries.unionByName(new), "entry_id", "ts").select(*entries.columns), keep)


def cache_stats(entries: DataFrame) -> DataFrame:
    """scope, n, and the times of the oldest and the newest entry."""
    return entries.groupBy("scope").agg(F.count("*").alias("n"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"))


def cache_cleared(entries: DataFrame, scope: str | None = None) -> DataFrame:
    """The entries without those of a scope; without any, where none is named."""
    return entries.where(F.lit(False)) if scope is None else entries.where(~F.col("scope").eqNullSafe(F.lit(scope)))


#: What changes make out of date: the keyword index too, or cached results alone.
_OUTDATES = {"document": ("index", "cache"), "dataset_commit": ("index", "cache"), "dataset": ("cache",)}


def versioned_scope(scope: Column, versions: DataFrame) -> Column:
    """A scope with the number of changes that concern cached results, so that entries of before are never met again."""
    n = versions.where(F.col("kind").isin([k for k, v in _OUTDATES.items() if "cache" in v])).count()
    return F.concat_ws("|", scope, F.lit(f"v{n}"))


def index_is_stale(versions: DataFrame, built_at) -> bool:
    """Whether a change since then concerns the keyword index; versions: kind and ts of each change."""
    kinds = [k for k, v in _OUTDATES.items() if "index" in v]
    return bool(versions.where(F.col("kind").isin(kinds) & (F.col("ts") > F.lit(built_at))).take(1))


def cacheable(response: Column) -> Column:
    """Whether a response carries an answer: struct(clarification, knowledge(found, source_tier, needs_web_confirmation), map(results))."""
    asks = F.coalesce(response["clarification"], F.lit("")) != ""
    waits = F.coalesce(response["knowledge"]["needs_web_confirmation"], F.lit(False)) | F.coalesce(response["knowledge"]["source_tier"].isin("error", "awaiting_confirmation"), F.lit(False))
    answers = F.coalesce(F.size(response["map"]["results"]) > 0, F.lit(False)) | F.coalesce(response["knowledge"]["found"], F.lit(False))
    return ~asks & ~waits & answers


# How a conversation notes what a map showed.
SHOWN, MORE, MAPPED = ("(showed on the map: ", ")"), (", and ", " more"), ("(mapped ", " feature(s))")


def reply_text(response: Column, names: int = 5) -> Column:
    """What a conversation keeps of a response: its answer, else what it asks, else the names of its first results."""
    results = response["map"]["results"]
    named = F.slice(F.array_distinct(F.filter(F.transform(results, lambda r: r["name"]), lambda n: F.coalesce(n, F.lit("")) != "")), 1, names)
    more = F.size(results) - F.size(named)
    within = lambda ends, x: F.concat(F.lit(ends[0]), x, F.lit(ends[1]))
    shown = within(SHOWN, F.concat(F.array_join(named, ", "), F.when(more > 0, within(MORE, more.cast("string"))).otherwise("")))
    listed = F.when(results.isNull(), "").when(F.size(named) > 0, shown).otherwise(within(MAPPED, F.size(results).cast("string")))
    full = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    return F.coalesce(full(response["knowledge"]["answer"]), full(response["clarification"]), listed)


def cache_trimmed(entries: DataFrame, keep: int = ENTRIES) -> DataFrame:
    """The newest entries of each scope."""
    newest = Window.partitionBy("scope").orderBy(F.desc("ts"), F.desc("entry_id"))
    return entries.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= keep).drop("_n")


def last_turns(turns: DataFrame, k: int = TURNS) -> DataFrame:
    """The last k rows (session, turn, …) of each session."""
    return turns.withColumn("_n", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("turn")))).where(F.col("_n") <= k).drop("_n")


def within_budget(turns: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The latest rows of each session whose token estimates add up to the budget at most, with tokens."""
    back = Window.partitionBy("session").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    sized = turns.withColumn("tokens", token_estimate(F.col("text")))
    return sized.withColumn("_sum", F.sum("tokens").over(back)).where(F.col("_sum") <= budget).drop("_sum")


def session_name(session: Column) -> Column:
    """The session that a name means; `default` where it is blank."""
    name = F.trim(session)
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit("default")).otherwise(name)


def without_session(turns: DataFrame, session: str | None) -> DataFrame:
    """The turns of all other sessions."""
    return turns.where(~session_name(F.col("session")).eqNullSafe(session_name(F.lit(session))))


def folded(turns: DataFrame, budget: int = BUDGET, summarize: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """session, summary and recent of each session: the latest rows within the budget as they are, earlier ones as a summary.

    summarize is given the texts of sessions (`role: text` lines) many at a time; without it there is no summary and
    only the last TURNS rows stay.
    """
    if summarize is None:
        recent = transcript(last_turns(turns))
        return recent.select("session", F.lit("").alias("summary"), F.col("transcript").alias("recent"))

    @F.pandas_udf("string")
    def told(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            full = [t for t in texts if t]
            made = iter(summarize(full) if full else [])
            yield pd.Series([next(made) if t else "" for t in texts], dtype="object")

    near = within_budget(turns, budget)
    early = turns.join(near.groupBy("session").agg(F.min("turn").alias("_first")), "session", "left").where("_first is null or turn < _first").drop("_first")
    both = transcript(near).select("session", F.col("transcript").alias("recent")).join(transcript(early).select("session", F.col("transcript").alias("_early")), "session", "full")
    return both.select("session", told(F.coalesce("_early", F.lit(""))).alias("summary"), F.coalesce("recent", F.lit("")).alias("recent"))


def condensed(query: str, history: str, rewrite: Callable[[str], str] | None) -> str:
    """A follow-up question as one that stands alone; the question itself where there is no history, no model, or its text is too long."""
    asked = query.strip()
    if rewrite is None or not history:
        return query
    try:
        made = rewrite(f"Conversation:\n{history}\n\nQuestion: {query}\n\nAs a question of its own:").strip().strip('"').strip()
    except Exception:  # a question is answered without it too
        return query
    return made if made and len(made) <= 4 * len(asked) + 200 else asked


def transcript(turns: DataFrame) -> DataFrame:
    """session, n_turns and transcript (`role: text` lines in order); blank turns are skipped."""
    rows = turns.where(F.trim("text") != "").groupBy("session").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line")))).alias("t"))
    return rows.select("session", F.size("t").cast("long").alias("n_turns"), F.array_join(F.transform("t", lambda x: x.line), "\n").alias("transcript"))


def module_tag(logger: Column) -> Column:
    last = F.element_at(F.split(logger, r"\."), -1)
    known = F.create_map(*(F.lit(x) for pair in MODULES.items() for x in pair))
    return F.coalesce(known[last], F.when(last != "", F.upper(last)).otherwise(F.lit("APP")))


def matching_logs(logs: DataFrame, text: str | None = None, modules: list[str] | None = None, levels: list[str] | None = None, since=None, until=None) -> DataFrame:
    """All log rows (id, ts, module, level, message, …) that meet all conditions, in no order.

    The text is looked for in message, target and logger, of which any may be null or missing.
    """
    rows = logs
    if text:
        searched = [c for c in ("message", "target", "logger") if c in logs.columns]
        rows = rows.where(reduce(lambda a, b: a | b, (F.coalesce(F.col(c).ilike(f"%{text}%"), F.lit(False)) for c in searched), F.lit(False)))
    for column, wanted in (("module", modules), ("level", levels)):
        rows = rows.where(F.col(column).isin(wanted)) if wanted else rows
    rows = rows.where(F.col("ts") >= F.lit(since)) if since is not None else rows
    rows = rows.where(F.col("ts") <= F.lit(until)) if until is not None else rows
    return rows


def search_logs(logs: DataFrame, text: str | None = None, modules: list[str] | None = None, levels: list[str] | None = None, since=None, until=None, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of matching_logs, the newest first; limit 1 to 100000."""
    rows = matching_logs(logs, text, modules, levels, since, until)
    return rows.orderBy(F.desc("ts"), F.desc("id")).offset(max(0, offset)).limit(min(100_000, max(1, limit)))


def module_counts(logs: DataFrame) -> DataFrame:
    """module and n, the number of its log rows."""
    return logs.groupBy("module").agg(F.count("*").alias("n"))


def logs_cleared(logs: DataFrame, before=None) -> DataFrame:
    """The log rows from a time on; none without one."""
    return logs.where(F.lit(False)) if before is None else logs.where(F.col("ts") >= F.lit(before))


def count_logs(logs: DataFrame, **conditions) -> DataFrame:
    """One row: total, the number of matching_logs whatever the page."""
    return matching_logs(logs, **conditions).agg(F.count("*").alias("total"))


# The columns of an exported log.
LOG_COLUMNS = ("iso", "module", "level", "message", "target", "duration_ms", "error_type", "logger")


def export_logs(logs: DataFrame, path: str, kind: str = "json") -> None:
    """Writes log rows as JSON lines, all columns, or as CSV with LOG_COLUMNS, of which a missing one is empty; the newest first."""
    rows = logs.withColumn("iso", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"))
    ordered = lambda df: df.orderBy(F.desc("ts"), F.desc("id"))
    if kind == "json":
        ordered(rows).write.mode("overwrite").json(path)
    elif kind == "csv":
        shown = [F.col(c).cast("string").alias(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in LOG_COLUMNS]
        ordered(rows).select(*shown).write.mode("overwrite").option("header", True).csv(path)
    else:
        raise ValueError(f"json or csv, not {kind}")
