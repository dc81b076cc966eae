"""Benchmark decontamination as a prefix-filtered set join.

A window of a benchmark item is a set of shingles that all must stand in a document, so one shingle is prefix enough:
the rarest over all documents. Documents' shingles are joined with those prefixes only, the place of the shingle
in the window and the lengths of both bound where the window can lie, and the words there are compared. Places and
hashes alone are joined and, where a side is too large to be broadcast, shuffled; words are read again for documents
with a candidate only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import ascii_lower, small_side, written

WINDOW, SHINGLE = 10, 5
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of the text with A-Z in lower case; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _BETWEEN, -1), "")


def _shingle(at: Column, size: int) -> Column:
    return F.xxhash64(*(F.get("words", at + k) for k in range(size)))


def windows(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct windows (win, words, size) and which item has which (item_id, win)."""
    items = benchmark.where("item_id is not null").select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(WINDOW))
    each = items.select("item_id", F.explode(F.sequence(F.lit(0), F.size("words") - size)).alias("at"), "words", size.alias("size"))
    each = each.select("item_id", F.slice("words", F.col("at") + 1, F.col("size")).alias("words"))
    of = written(each.select("item_id", F.array_join("words", " ").alias("win"), "words").distinct(), "windows")
    return of.select("win", "words", F.size("words").alias("size")).distinct(), of.select("item_id", "win")


def _shingles(at: Column, sizes: list[int]) -> Column:
    """Hash of the shingle of `size` words that begins at a place; size is one of the column's values in sizes."""
    out = F.lit(None).cast("long")
    for size in sizes:
        out = F.when(F.col("size") == size, _shingle(at, size)).otherwise(out) if len(sizes) > 1 else _shingle(at, size)
    return out


def places(texts: DataFrame, sizes: list[int]) -> DataFrame:
    """doc_id, tag, n (words of the text), pos and h of each shingle of each size, from one pass over the texts.

    Rows hold no words, so that they stay small where they have to be shuffled.
    """
    least = min(sizes)
    each = texts.where(F.size("words") >= least).select("doc_id", "tag", "words", F.explode(F.sequence(F.lit(0), F.size("words") - least)).alias("pos"))
    each = each.withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).where(F.col("pos") + F.col("size") <= F.size("words")) if len(sizes) > 1 else each.withColumn("size", F.lit(least))
    return each.select("doc_id", "tag", F.size("words").alias("n"), "pos", _shingles(F.col("pos"), sizes).alias("h"))


def occurrences(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """doc_id, tag (hash of the text), start, size and win of each place where a window stands in a document.

    The texts are split into words twice: once all of them, for the places of shingles that windows have, and once
    those in which a window may stand, a row for each text, to compare the words there.
    """
    texts = docs.select("doc_id", F.xxhash64("text").alias("tag"), words(F.col("text")).alias("words"))
    sizes = sorted(r[0] for r in distinct.select(F.least("size", F.lit(SHINGLE)).alias("s")).distinct().collect())  # 1 to SHINGLE
    if not sizes:
        return texts.where("false").select("doc_id", "tag", F.lit(0).alias("start"), F.lit(0).alias("size"), F.lit("").alias("win"))
    part = F.least("size", F.lit(SHINGLE))
    parts = distinct.select("win", F.col("size").alias("window"), "words", part.alias("size"), F.explode(F.sequence(F.lit(0), F.col("size") - part)).alias("offset"))
    parts = written(parts.select("win", "window", "offset", _shingles(F.col("offset"), sizes).alias("h")), "window-shingles")
    found = written(places(texts, sizes).join(small_side(parts.select("h").distinct()), "h"), "shingle-places")
    ranked = parts.join(found.groupBy("h").agg(F.count("*").alias("df")), "h", "left").fillna(0, "df")
    first = Window.partitionBy("win").orderBy("df", "h", "offset")
    # A window with a shingle that no document has stands nowhere.
    prefix = written(ranked.withColumn("nth", F.row_number().over(first)).where("nth = 1 and df > 0").drop("nth", "df"), "prefixes")
    start = F.col("pos") - F.col("offset")
    near = found.join(small_side(prefix), "h").where((start >= 0) & (start + F.col("window") <= F.col("n")))
    near = near.groupBy("doc_id", "tag").agg(F.collect_set(F.struct(start.alias("start"), F.col("window").alias("size"), "win")).alias("near"))
    near = written(near.withColumnsRenamed({"doc_id": "near id", "tag": "near tag"}), "candidates")
    key = F.col("doc_id").eqNullSafe(F.col("near id")) & (F.col("tag") == F.col("near tag"))
    # Texts of other documents are sorted out by ids alone, which are small, before any text is moved.
    rows = docs.select("doc_id", F.xxhash64("text").alias("tag"), "text").join(small_side(near.select("near id", "near tag")), key, "left_semi")
    both = rows.join(near, key)
    same = lambda c: F.array_join(F.slice("words", c["start"] + 1, c["size"]), " ") == c["win"]
    stand = both.withColumn("words", words(F.col("text"))).select("doc_id", "tag", F.explode(F.filter("near", same)).alias("hit"))
    return stand.select("doc_id", "tag", "hit.*").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each row of docs.

    Null texts have no words; items without words or without item_id have no windows. Rows without doc_id are judged
    like others, repeated rows give repeated results, and an empty table, or an empty benchmark, gives no hit.
    Columns of the same names in both tables don't meet: only doc_id, item_id and text are looked at.
    """
    distinct, of = windows(benchmark)
    hits = written(occurrences(docs, distinct), "occurrences")
    row = ["doc_id", "tag"]
    before = F.max(F.col("start") + F.col("size")).over(Window.partitionBy(*row).orderBy("start", "size", "win").rowsBetween(Window.unboundedPreceding, -1))
    end = F.col("start") + F.col("size")
    covered = hits.select(*row, F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(before, "start"))).alias("n")).groupBy(*row).agg(F.sum("n").cast("long").alias("n_hit"))
    items = hits.select(*row, "win").distinct().join(of, "win").select(*row, "item_id").distinct()
    items = items.groupBy(*row).agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list(F.col("item_id").cast("string"))), ",").alias("items"))
    found = covered.join(items, [covered["doc_id"].eqNullSafe(items["doc_id"]), covered["tag"] == items["tag"]]).select(covered["doc_id"].alias("hit_id"), covered["tag"].alias("hit_tag"), "n_hit", "n_items", "items")
    rows = docs.select("doc_id", F.xxhash64("text").alias("tag"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    all_ = rows.join(found, rows["doc_id"].eqNullSafe(F.col("hit_id")) & (rows["tag"] == F.col("hit_tag")), "left")
    return all_.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no window of the benchmark stands, with the columns of docs.

    Null and empty texts have no words and stay; so do all rows where the benchmark is empty. Rows without doc_id and
    rows of one doc_id with different texts are judged each by its own text; repeated rows stay or go together. An
    empty table gives none. Columns of docs named like those of the benchmark stay as they are.
    """
    distinct, _ = windows(benchmark)
    hit = written(occurrences(docs, distinct).select(F.col("doc_id").alias("hit_id"), F.col("tag").alias("hit_tag")).distinct(), "contaminated")
    hit = hit.select(F.col("hit_id").alias("hit id"), F.col("hit_tag").alias("hit tag"))
    held = docs.withColumn("row tag", F.xxhash64("text"))
    return held.join(small_side(hit), F.col("doc_id").eqNullSafe(F.col("hit id")) & (F.col("row tag") == F.col("hit tag")), "left_anti").drop("row tag")
