"""Keyword, dense and hybrid retrieval over chunks (chunk_id, text)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import overlap, root_domain, stable_uuid
from lodestone.operators.chunking import recursive_chunks
from lodestone.operators.keyword_index import KeywordIndex, bm25
from lodestone.scratch import exists, small_side

# The rank constant of fusion, sizes of the pool and of the result.
RRF_K, POOL, TOP = 60, 20, 5
# Weights and thresholds of sufficiency.
DENSE_WEIGHT, OVERLAP_WEIGHT, ENOUGH, LEAST_OVERLAP = 0.6, 0.4, 0.35, 0.05
# Domains that are nobody's own site, and endings of official ones.
BLOCKED_DOMAINS = (
    "linkedin.com", "facebook.com", "twitter.com", "x.com", "instagram.com", "youtube.com", "tiktok.com", "pinterest.com", "reddit.com", "quora.com", "wikipedia.org", "wikiwand.com", "fandom.com",
    "tripadvisor.com", "yelp.com", "foursquare.com", "glassdoor.com", "indeed.com", "crunchbase.com", "zoominfo.com", "bloomberg.com", "mapquest.com", "yellowpages.com", "medium.com",
    "blogspot.com", "wordpress.com", "amazon.com", "booking.com",
)
OFFICIAL = (".edu", ".gov", ".ac.", ".edu.eg", ".gov.eg", ".org")


def top(scores: DataFrame, k: int, positive: bool = False) -> DataFrame:
    """The k best of (chunk_id, score) with rank from 1, ties by chunk_id; those not above 0 go after the cut."""
    best = scores.orderBy(F.desc("score"), "chunk_id").limit(k)
    best = best.where("score > 0") if positive else best
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")))  # k rows


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def normalized(v: Column) -> Column:
    """The vector at length 1; a vector of zeros stays."""
    size = F.sqrt(dot(v, v))
    return F.when(size > 0, F.transform(v, lambda x: x / size)).otherwise(v)


def prefixed(text: str, prefix: str) -> str:
    """The text after the prefix that a model expects, unless it begins with it or there is none."""
    return text if not prefix.strip() or text.startswith(prefix.strip()) else f"{prefix.strip()} {text}"


def embedded(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], prefix: str = "passage:", batch: int = 32, text: str = "text") -> DataFrame:
    """chunks with embedding, of length 1: embed is given `batch` texts at a time, each after the prefix, in each task.

    A null text counts as empty.
    """
    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            given = [prefixed(t, prefix) for t in texts]
            yield pd.Series([v for at in range(0, len(given), batch) for v in embed(given[at : at + batch])])

    given = chunks.withColumn("embedding", run(F.coalesce(F.col(text), F.lit(""))))
    return given.withColumn("embedding", normalized(F.col("embedding")).cast("array<float>"))


def reranked(hits: DataFrame, query: str, score: Callable[[str, list[str]], list[float]] | None) -> DataFrame:
    """hits (chunk_id, rank, text) with rank anew by the scores of a pair model; without one, or where it fails, as they are."""
    rows = hits.orderBy("rank").collect()  # the hits of one question
    try:
        scores = score(query, [r.text for r in rows]) if score else None
    except Exception:  # the model is an extra; the order that is there will do
        scores = None
    if scores is None:
        return hits
    order = sorted(range(len(rows)), key=lambda i: (-scores[i], rows[i]["rank"]))
    at = {rows[i].chunk_id: place for place, i in enumerate(order, 1)}
    ranks = hits.sparkSession.createDataFrame(list(at.items()), hits.select("chunk_id", "rank").schema)
    return hits.drop("rank").join(F.broadcast(ranks), "chunk_id").select(*hits.columns)


def metadata_filter(df: DataFrame, filters: dict | None) -> DataFrame:
    """Equal to a value, or one of a list; None is skipped; all must hold."""
    tests = [F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(c) == v for c, v in (filters or {}).items() if v is not None]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def dense(vectors: DataFrame, query: list[float], filters: dict | None = None) -> DataFrame:
    """chunk_id and score (cosine) of vectors (chunk_id, embedding and metadata)."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return metadata_filter(vectors, filters).select("chunk_id", cosine(F.col("embedding"), q).alias("score"))


def fuse(lists: list[tuple[DataFrame, float]], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (chunk_id, rank) lists with weights: chunk_id and score."""
    parts = [df.select("chunk_id", (F.lit(float(w)) / (k + F.col("rank"))).alias("s"), F.lit(i).alias("list"), "rank") for i, (df, w) in enumerate(lists)]
    return reduce(DataFrame.unionByName, parts).groupBy("chunk_id").agg(F.sum("s").alias("score"), F.min(F.struct("list", "rank")).alias("_first"))


def hybrid(chunks: DataFrame, vectors: DataFrame, query: str, vector: list[float], filters: dict | None = None, pool: int = POOL, k: int = TOP, index: KeywordIndex | None = None) -> DataFrame:
    """The k best chunks of both rankings, fused; the filter holds for both sides. Ties come in the order of the lists.

    With an index, its scores over all chunks count and the filter picks among them; without one, the chunks that the
    filter leaves are indexed for this question.
    """
    near = top(dense(vectors, vector, filters), pool)
    left = metadata_filter(chunks, filters)
    scores = index.top(query, pool, left if filters else None) if index else bm25(left, query)
    words = top(scores, pool, positive=True)
    best = fuse([(near, 1.0), (words, 1.0)]).orderBy(F.desc("score"), "_first").limit(k).drop("_first")
    a, b = near.select("chunk_id", F.col("score").alias("dense_score")), words.select("chunk_id", F.col("score").alias("bm25_score"))
    return best.join(a, "chunk_id", "left").join(b, "chunk_id", "left")


def merged(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The rows of two lists of hits by key, of either or of both, with in_left and in_right."""
    a, b = left.withColumn("in_left", F.lit(True)), right.withColumn("in_right", F.lit(True))
    both = a.join(b, key, "full")
    return both.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("in_left", "in_right")})


def min_max(hits: DataFrame, score: str, by: str) -> DataFrame:
    """hits with scaled: the scores of each query from 0 to 1; 1 where all are equal.

    The ends are sums of groups that hits are joined to, so that no query's hits are gathered in one task.
    """
    ends = hits.groupBy(F.col(by).alias("_by")).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    scaled = F.when(F.col("_hi") == F.col("_lo"), F.lit(1.0)).otherwise((F.col(score) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return hits.join(small_side(ends), F.col(by).eqNullSafe(F.col("_by"))).withColumn("scaled", scaled).drop("_by", "_lo", "_hi")


def sufficiency(hits: DataFrame) -> DataFrame:
    """query_id, top_dense, overlap, score and enough from hits (query_id, query, text, dense_score, cross_script)."""
    each = hits.groupBy("query_id").agg(
        F.coalesce(F.max("dense_score"), F.lit(0.0)).alias("top_dense"), F.max(overlap(F.col("query"), F.col("text"))).alias("overlap"), F.bool_or("cross_script").alias("cross")
    )
    score = DENSE_WEIGHT * F.col("top_dense") + OVERLAP_WEIGHT * F.col("overlap")
    return each.withColumn("score", score).withColumn("enough", F.when(F.col("cross"), F.col("top_dense") >= ENOUGH).otherwise((score >= ENOUGH) & (F.col("overlap") >= LEAST_OVERLAP))).drop("cross")


def blocked_domain(domain: Column) -> Column:
    return reduce(lambda a, b: a | b, ((domain == d) | domain.endswith("." + d) for d in BLOCKED_DOMAINS))


def domain_score(domain: Column, entity: Column) -> Column:
    names = F.filter(F.split(F.lower(entity), r"\W+"), lambda t: F.length(t) > 2)
    named = F.when(F.exists(names, lambda t: domain.contains(t)), 2.0).otherwise(0.0)
    official = F.when(reduce(lambda a, b: a | b, (domain.contains(x) for x in OFFICIAL)), 1.5).otherwise(0.0)
    return named + official + F.greatest(F.lit(0.0), 1.0 - 0.1 * F.regexp_count(domain, F.lit(r"\.")))


def url_rank(url: Column, query: str, site: str, keywords: tuple[str, ...] = ()) -> Column:
    """How well a url of a site suits a query; -1 off the site."""
    import re

    path = F.lower(F.regexp_extract(url, r"://[^/?#]*([^#]*)", 1))
    words = {t for t in re.findall(r"[^\W\d_]+", query.lower()) if len(t) > 2}
    hits = reduce(lambda a, b: a + b, (F.contains(path, F.lit(w)).cast("int") for w in sorted(words) + list(keywords)), F.lit(0))
    host, base = root_domain(url), re.sub(r"^www\.", "", re.sub(r"^\w+://", "", site.lower()).split("/")[0])
    off = ~host.contains(base) & ~F.lit(base).contains(host)
    return F.when(off & (host != ""), F.lit(-1.0)).otherwise(hits - 0.1 * F.regexp_count(path, F.lit("/")))


def distinctive_overlap(query: str, text: Column, site: str) -> Column:
    """The share of the query's words that a text has, without those that the site's host is made of."""
    import re

    host = re.sub(r"^[a-z]+://", "", site.lower()).split("/")[0]
    own = set(re.findall(r"[^\W\d_]+", host))
    return overlap(F.lit(" ".join(w for w in re.findall(r"[^\W\d_]+", query) if w.lower() not in own)), text)


def page_context(pages: DataFrame, query: str, embed: Callable[[list[str]], list[list[float]]], k: int = TOP) -> DataFrame:
    """rank, url and text of the k pieces of pages (url, text) that are nearest to a query; nothing is kept of them."""
    pieces = recursive_chunks(pages.select(F.col("url").alias("doc_id"), "text"))
    pieces = pieces.withColumn("chunk_id", F.concat_ws("#", "doc_id", F.lpad(F.col("chunk_index").cast("string"), 9, "0")))
    asked = embed([prefixed(query, "query:")])[0]
    size = sum(x * x for x in asked) ** 0.5 or 1.0
    q = F.array(*(F.lit(x / size) for x in asked))
    vectors = embedded(pieces, embed).withColumn("score", dot(F.col("embedding"), q))
    best = top(vectors.select("chunk_id", "score"), k)
    return best.join(pieces, "chunk_id").select("rank", F.col("doc_id").alias("url"), "text").orderBy("rank")


def expansion(chunks: DataFrame, document: Column | str, limit: int = 40) -> DataFrame:
    """The first chunks of a document, in order."""
    return chunks.where(F.col("document_id") == document).orderBy("chunk_index").limit(limit)


def expansion_of_best(hits: DataFrame, chunks: DataFrame, limit: int = 40) -> DataFrame:
    """The first chunks of the document of the best of hits (chunk_id, rank); no row without a hit."""
    best = hits.orderBy("rank").limit(1).select("chunk_id").join(chunks, "chunk_id").select("document_id")  # one row
    return chunks.join(F.broadcast(best), "document_id", "left_semi").orderBy("chunk_index").limit(limit)


def document_list(documents: DataFrame) -> DataFrame:
    """Documents (document_id, upload_date, …), the latest first, ties by id."""
    return documents.orderBy(F.desc("upload_date"), "document_id")


def without_document(chunks: DataFrame, documents: DataFrame, ids: list[str]) -> tuple[DataFrame, DataFrame]:
    """Chunks and documents without the documents of these ids; the chunks are to be written first."""
    gone = F.col("document_id").isin(ids)
    return chunks.where(~F.coalesce(gone, F.lit(False))), documents.where(~F.coalesce(gone, F.lit(False)))


def provision(spark: SparkSession, path: str, schema: str) -> bool:
    """Makes an empty collection of a schema; False where there is one already."""
    if exists(spark, path):
        return False
    spark.createDataFrame([], schema).write.parquet(path)
    return True


def stored_count(spark: SparkSession, path: str) -> int:
    """The rows of a stored collection; 0 where there is none."""
    return spark.read.parquet(path).count() if exists(spark, path) else 0


def distinct_sections(chunks: DataFrame) -> DataFrame:
    """Sections of each document, letter case aside, by first sight."""
    first = chunks.where("section is not null and section != ''").groupBy("document_id", F.lower("section").alias("_k")).agg(F.min_by("section", "chunk_index").alias("section"), F.min("chunk_index").alias("first_index"))
    return first.drop("_k")


def latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The last version of each key: an upsert whose repetition changes nothing."""
    names = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(version, F.xxhash64(*names))).alias("r")).select(key, "r.*")


# Fixed value: the namespace of the ids of stored chunks.
POINT_NAMESPACE = "6f9619ff-8b86-d011-b42d-00cf4fc964ff"


def with_point_ids(chunks: DataFrame) -> DataFrame:
    """chunks with point_id, the same for the same chunk_id at all times, so that storing a chunk again replaces it."""
    return chunks.withColumn("point_id", stable_uuid(F.col("chunk_id"), POINT_NAMESPACE))


def orphans(chunks: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """Chunks whose document is gone."""
    return chunks.join(documents.select(key), key, "left_anti")


def lookup(layer: DataFrame, label: str, name: str, key: str, limit: int = 5) -> DataFrame:
    """Records whose label has the name in it, or (from three characters) stands in the name."""
    low = F.lower(F.col(label))
    return layer.where(low.contains(name.lower()) | ((F.length(label) >= 3) & F.lit(name.lower()).contains(low))).orderBy(key).limit(limit)


def record_text(df: DataFrame, skip: tuple[str, ...] = ()) -> Column:
    """`column: value | …` of the columns that have a value."""
    shown = [c for c in df.columns if c not in skip]
    full = lambda c: F.col(c).isNotNull() & ~F.lower(F.trim(F.col(c).cast("string"))).isin("", "nan")
    return F.concat_ws(" | ", *(F.when(full(c), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in shown))
