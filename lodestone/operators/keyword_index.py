"""A stored BM25 index in segments: chunks come and go without a rebuild, and the best are found without reading all.

A commit writes one segment and never changes another. Its statistics are signed: chunks that are taken away, or come
again, count as -1 in the segment that says so, and their ids are its tombstones, which hold for the segments before
it. So all sizes and document frequencies are sums over segments. The chunks of a segment lie in blocks of like length;
for each term of a block the largest count and the least length bound what it can add to a score.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import tokens
from lodestone.scratch import exists, file_system, written

# BM25's constants.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Chunks of a block, about; blocks that a search reads first; segments that are merged into one.
BLOCK, FIRST_BLOCKS, FAN_IN = 256, 64, 8
#: Blocks that a search names to the reader one by one; beyond that it joins them.
NAMED_BLOCKS = 1000


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def counted(chunks: DataFrame) -> DataFrame:
    """chunk_id, length, and the distinct terms of each chunk with their counts; a chunk is one row, so nothing is shuffled.

    Sorted words have equal ones in runs, so the count of a term is the distance between the beginnings of two runs.
    """
    def runs(words: Column) -> Column:
        n = F.size(words)
        begins = lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1))
        at = F.when(n > 0, F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), begins)).otherwise(F.array().cast("array<int>"))
        next_at = lambda at: F.concat(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), F.array(n))
        tf = lambda at: F.zip_with(at, F.slice(next_at(at), 1, F.size(at)), lambda a, b: (b - a).cast("long"))
        return _with(at, lambda at: F.struct(n.alias("length"), F.transform(at, lambda i: F.get(words, i)).alias("terms"), tf(at).alias("tf")))

    return chunks.select("chunk_id", _with(F.array_sort(tokens(F.col("text"))), runs).alias("c")).select("chunk_id", "c.length", "c.terms", "c.tf")


def _postings(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("chunk_id", "length", *more, F.explode(F.arrays_zip("terms", "tf")).alias("p")).select("chunk_id", "length", *more, F.col("p.terms").alias("term"), F.col("p.tf").alias("tf"))


def _idf(n: Column) -> Column:
    return F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def _times(spark: SparkSession, query: str) -> Counter:
    """How often each term stands in a query; words of one question."""
    return Counter(r[0] for r in spark.range(1).select(F.explode(tokens(F.lit(query)))).collect())


def _weights_of(times: Counter, df: DataFrame, n: int, mean_idf: float) -> dict[str, float]:
    """The weight of each term that any chunk has: EPSILON times the mean idf where it is in over half of them."""
    rows = df.where(F.col("term").isin(list(times))).withColumn("idf", _idf(F.lit(n))).collect()
    return {r.term: times[r.term] * (r.idf if r.idf >= 0 else EPSILON * mean_idf) for r in rows}


def _scored(postings: DataFrame, weights: dict[str, float], mean: float) -> DataFrame:
    """chunk_id and score from the postings of the weights' terms."""
    idf = F.create_map(*(F.lit(v) for pair in weights.items() for v in pair))[F.col("term")]
    part = _part(idf, F.col("tf"), F.col("length"), F.lit(mean))
    # Added up in order, so that chunks of the same numbers have the same score whatever task they come from.
    added = F.aggregate(F.array_sort(F.collect_list(part)), F.lit(0.0), lambda s, x: s + x)
    return postings.groupBy("chunk_id").agg(added.alias("score"))


def bm25(chunks: DataFrame, query: str) -> DataFrame:
    """chunk_id and score of each chunk (chunk_id, text) that has a term of the query.

    For one question: chunks are read once, and what is kept of them are counts, not an index in order.
    """
    spark = chunks.sparkSession
    rows = written(counted(chunks), "counted-chunks")
    size = rows.agg(F.count("*").alias("n"), F.sum("length").alias("words")).first()
    df = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    mean_idf = df.agg(F.avg(_idf(F.lit(size.n))).alias("m")).first().m
    times = _times(spark, query)
    asked = rows.select("chunk_id", "length", F.filter(F.arrays_zip("terms", "tf"), lambda p: p.terms.isin(list(times))).alias("p")).where(F.size("p") > 0)
    postings = asked.select("chunk_id", "length", F.explode("p").alias("p")).select("chunk_id", "length", F.col("p.terms").alias("term"), F.col("p.tf").alias("tf"))
    few = postings.groupBy("term").agg(F.count("*").alias("df"))
    weights = _weights_of(times, few, size.n, mean_idf) if mean_idf is not None else {}
    if not weights:
        return chunks.select("chunk_id").limit(0).withColumn("score", F.lit(0.0))
    return _scored(postings, weights, size.words / size.n)


def _part(idf: Column, tf: Column, length: Column, mean: Column) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


class KeywordIndex:
    """BM25 over the segments that the last manifest names, in one folder.

    A manifest is written when its segment is whole, so a reader sees one state or the next. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        fs, at = file_system(spark, path)
        found = [int(n[9:]) for s in fs.listStatus(at) if (n := s.getPath().getName()).startswith("manifest-") and exists(spark, f"{path}/{n}/_SUCCESS")] if fs.exists(at) else []
        self.number = max(found, default=-1)
        state = json.loads(spark.read.text(f"{path}/manifest-{self.number}").first()[0]) if found else {"segments": [], "n": 0, "words": 0, "mean_idf": 0.0, "key": None}
        self.segments, self.n, self.words, self.mean_idf, self.key = (state[k] for k in ("segments", "n", "words", "mean_idf", "key"))
        #: Blocks that the last search read, and of how many that hold a term of it.
        self.read = (0, 0)

    @classmethod
    def build(cls, chunks: DataFrame, path: str) -> KeywordIndex:
        """An index of chunks (chunk_id, text) alone, in place of what the folder had; null texts have no term but count."""
        index = cls(chunks.sparkSession, path)
        index.segments = []
        return index._committed(index._segment(chunks, None))

    def put(self, chunks: DataFrame) -> KeywordIndex:
        """Adds chunks (chunk_id, text); those of ids that are there already come in their place."""
        chunks = written(chunks.select("chunk_id", "text"), "new-chunks")
        return self._grown(self._segment(chunks, chunks.select("chunk_id").distinct() if self.segments else None))

    def delete(self, ids: DataFrame) -> KeywordIndex:
        """Takes away the chunks of these ids (chunk_id); ids that are not there change nothing."""
        if not self.segments:
            return self
        none = self.spark.createDataFrame([], f"chunk_id {self.key}, text string")
        return self._grown(self._segment(none, ids.select("chunk_id").distinct()))

    def _grown(self, segment: dict) -> KeywordIndex:
        index = self._committed(segment)
        return index.compact() if len(index.segments) >= FAN_IN else index

    def compact(self) -> KeywordIndex:
        """All segments as one, without what tombstones took away."""
        if not self.segments:
            return self
        name = uuid.uuid4().hex
        self._write(name, self._live("chunks"), self._live("postings").select("term", "block", "chunk_id", "length", "tf"), None)
        self.segments = []
        return self._committed(self._summed(name, False))

    # ---- segments ---------------------------------------------------------------------------------------------------

    def _segment(self, chunks: DataFrame, gone: DataFrame | None) -> dict:
        """Writes a segment of chunks, with the ids that are gone before it."""
        name = uuid.uuid4().hex
        rows = written(counted(chunks), "counted-chunks")
        # Chunks of like length share blocks, so that the bounds of a block are near what its chunks have.
        band = F.floor(F.log2(F.col("length") + 1.0) * 4).cast("int")
        bands = rows.groupBy(band.alias("band")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).collect()  # a row for each fourth of a power of two
        blocks = F.create_map(*(F.lit(v) for r in bands for v in (r.band, r.blocks))) if bands else F.create_map().cast("map<int,int>")
        rows = rows.withColumn("block", (band * (1 << 24) + F.pmod(F.xxhash64("chunk_id"), F.coalesce(blocks[band], F.lit(1)))).cast("int"))
        kind = chunks.schema["chunk_id"].dataType.simpleString()
        self.key = self.key or kind
        if gone is not None:
            gone = written(gone, "gone")
        self._write(name, rows.select("chunk_id", "block", "length"), _postings(rows, "block").select("term", "block", "chunk_id", "length", "tf"), gone)
        return self._summed(name, gone is not None)

    def _write(self, name: str, chunks: DataFrame, postings: DataFrame, gone: DataFrame | None) -> None:
        at = f"{self.path}/{name}"
        chunks.write.parquet(f"{at}/chunks")
        postings.repartitionByRange("term", "block").sortWithinPartitions("term", "block", "chunk_id").write.option("parquet.block.size", 4 << 20).parquet(f"{at}/postings")
        kept = self.spark.read.parquet(f"{at}/postings")
        bounds = kept.groupBy("term", "block").agg(F.max("tf").alias("tf"), F.min("length").alias("length"))
        bounds.sortWithinPartitions("term", "block").write.parquet(f"{at}/bounds")
        added = kept.groupBy("term").agg(F.count("*").alias("df"))
        if gone is not None:
            gone.write.parquet(f"{at}/gone")
            off = self._live("postings").join(gone, "chunk_id", "left_semi").groupBy("term").agg((-F.count("*")).alias("df"))
            added = added.unionByName(off).groupBy("term").agg(F.sum("df").alias("df"))
        added.sortWithinPartitions("term").write.parquet(f"{at}/terms")

    def _summed(self, name: str, gone: bool) -> dict:
        """What a manifest says of a segment; its sizes are those that it adds."""
        both = self.spark.read.parquet(f"{self.path}/{name}/chunks").select(F.lit(1).alias("sign"), "length")
        if gone:
            off = self._live("chunks").join(self.spark.read.parquet(f"{self.path}/{name}/gone"), "chunk_id", "left_semi")
            both = both.unionByName(off.select(F.lit(-1).alias("sign"), "length"))
        r = both.agg(F.coalesce(F.sum("sign"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("sign") * F.col("length")), F.lit(0)).alias("words")).first()
        return {"name": name, "gone": gone, "n": r.n, "words": r.words}

    def _committed(self, segment: dict) -> KeywordIndex:
        """Writes the manifest of the segments with this one."""
        segments = [*self.segments, segment]
        n, words = (sum(s[k] for s in segments) for k in ("n", "words"))
        idf = self._sums([s["name"] for s in segments]).agg(F.avg(_idf(F.lit(n))).alias("m")).first().m
        state = {"segments": segments, "n": n, "words": words, "mean_idf": idf or 0.0, "key": self.key}
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.text(f"{self.path}/manifest-{self.number + 1}")
        return KeywordIndex(self.spark, self.path)

    def _sums(self, names: list[str], wanted: Column | None = None) -> DataFrame:
        """term and df of the terms that any chunk has, summed over segments."""
        parts = [self.spark.read.parquet(f"{self.path}/{n}/terms") for n in names]
        parts = parts if wanted is None else [p.where(wanted) for p in parts]
        return reduce(DataFrame.unionByName, parts).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def _live(self, what: str, wanted: Column | None = None) -> DataFrame:
        """Rows of all segments, with _segment, without those that a later segment's tombstones name."""
        parts = []
        for i, s in enumerate(self.segments):
            rows = self.spark.read.parquet(f"{self.path}/{s['name']}/{what}")
            rows = (rows if wanted is None else rows.where(wanted)).withColumn("_segment", F.lit(i))
            later = [self.spark.read.parquet(f"{self.path}/{t['name']}/gone") for t in self.segments[i + 1 :] if t["gone"]]
            if later and what != "bounds":
                rows = rows.join(reduce(DataFrame.unionByName, later), "chunk_id", "left_anti")
            parts.append(rows)
        return reduce(DataFrame.unionByName, parts)

    # ---- questions --------------------------------------------------------------------------------------------------

    def _weights(self, query: str) -> dict[str, float]:
        times = _times(self.spark, query)
        if not times or not self.segments:
            return {}
        return _weights_of(times, self._sums([s["name"] for s in self.segments], F.col("term").isin(list(times))), self.n, self.mean_idf)

    def _none(self) -> DataFrame:
        return self.spark.createDataFrame([], f"chunk_id {self.key or 'string'}, score double")

    def scores(self, query: str) -> DataFrame:
        """chunk_id and score of each chunk that has a term of the query."""
        weights = self._weights(query)
        if not weights:
            return self._none()
        return _scored(self._live("postings", F.col("term").isin(list(weights))), weights, self.words / self.n)

    def top(self, query: str, k: int, only: DataFrame | None = None) -> DataFrame:
        """chunk_id and score of the k best of scores(query), ties by chunk_id, among the chunks of `only` if given.

        Blocks are read by what their bounds allow, best first; when k are found, those that could not reach the k-th
        are left unread.
        """
        weights = self._weights(query)
        if not weights:
            self.read = (0, 0)
            return self._none()
        wanted = F.col("term").isin(list(weights))
        # What weighs less than nothing can't raise a score.
        most = F.create_map(*(F.lit(v) for t, w in weights.items() for v in (t, max(w, 0.0))))[F.col("term")]
        bound = F.sum(_part(most, F.col("tf"), F.col("length"), F.lit(self.words / self.n)))
        blocks = written(self._live("bounds", wanted).groupBy("_segment", "block").agg(bound.alias("bound")), "block-bounds")
        first = blocks.orderBy(F.desc("bound"), "_segment", "block").limit(FIRST_BLOCKS + 1).collect()
        total = blocks.count()

        def best_of(some: Column | DataFrame) -> list:
            rows = self._live("postings", wanted)
            rows = rows.where(some) if isinstance(some, Column) else rows.join(some, ["_segment", "block"], "left_semi")
            found = _scored(rows, weights, self.words / self.n)
            found = found if only is None else found.join(only.select("chunk_id"), "chunk_id", "left_semi")
            return found.orderBy(F.desc("score"), "chunk_id").limit(k).collect()

        def named(rows: list) -> Column:
            """These blocks; the reader skips row groups by their numbers."""
            by: dict[int, list[int]] = {}
            for r in rows:
                by.setdefault(r["_segment"], []).append(r["block"])
            return reduce(lambda a, b: a | b, ((F.col("_segment") == s) & F.col("block").isin(b) for s, b in by.items()))

        best, read = best_of(named(first[:FIRST_BLOCKS])), min(len(first), FIRST_BLOCKS)
        least = best[-1].score - 1e-9 if len(best) == k else -np.inf
        if len(first) > FIRST_BLOCKS and first[-1].bound >= least:
            rest = blocks.where(F.col("bound") >= float(least)) if np.isfinite(least) else blocks
            some = rest.limit(NAMED_BLOCKS + 1).collect()
            best = best_of(named(some) if len(some) <= NAMED_BLOCKS else rest.select("_segment", "block"))
            read = len(some) if len(some) <= NAMED_BLOCKS else rest.count()
        self.read = (read, total)
        return self.spark.createDataFrame([(r.chunk_id, float(r.score)) for r in best], self._none().schema)
