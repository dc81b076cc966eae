"""A stored index of vectors with exact answers: lists around centres, and bounds that skip what can't be near.

Vectors are compared by cosine, so their directions are points of the unit sphere and distances between these obey the
triangle inequality. Each vector lies in the list of its nearest centre, at a known distance from it. A vector at most
t away from a question lies at a distance from the centre that differs by t at most from the question's own, so lists
are skipped by their ranges of distances, and of a list, which is stored in that order, a range is read. Many questions
at a time are compared with blocks of lists as matrices.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators.retrieval import cosine, metadata_filter
from lodestone.scratch import exists, file_system

#: Vectors that centres are found from, rounds that move them, and the most lists there are.
SAMPLE, ROUNDS, LISTS = 20_000, 5, 4096
#: What bounds give way by, so that rounding skips nothing, and what products of directions give way by.
SLACK, ROUNDING = 1e-6, 1e-9
#: Numbers in the vectors of a side that a task compares at a time, and numbers in a table that it makes of them.
NUMBERS, CELLS = 1 << 21, 1 << 20


def directions(column: pa.Array, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The vectors at length 1, and which of them have a direction: not null, of the given size, finite, not all zero."""
    lengths = pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False)
    size = size or max(1, int(lengths.max(initial=1)))
    good = lengths == size
    x = np.zeros((len(lengths), size))
    if good.any():
        flat = column.filter(pa.array(good)).flatten().cast(pa.float64())
        x[good] = flat.to_numpy(zero_copy_only=False).reshape(-1, size)  # a null entry is not a number here
    good &= np.isfinite(x).all(axis=1)
    x[~good] = 0
    norm = np.sqrt((x * x).sum(axis=1))
    good &= (norm > 0) & np.isfinite(norm)
    x[good] /= norm[good, None]
    x[~good] = 0
    return x, good


def apart(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances of directions from centres."""
    square = (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1) - 2 * x @ centres.T
    return np.sqrt(np.maximum(square, 0))


def centres_of(vectors: DataFrame, column: str, lists: int, sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of so many lists at most, by Lloyd's rounds over a random sample of so many vectors.

    The sample only shapes the lists; every vector is indexed and found whatever they are. Tasks draw it, so that the
    driver is given about so many vectors in all, and not so many of each task to choose from.
    """
    some = vectors.where(F.col(column).isNotNull() & (F.size(column) > 0)).select(F.col(column).cast("array<double>").alias("v"))
    n = some.count()
    drawn = some.where(F.rand(7) < sample / n) if n > sample else some
    rows = drawn.toArrow().column("v").combine_chunks()
    if not len(rows):
        return np.zeros((1, 1))
    sizes, times = np.unique(pc.list_value_length(rows).to_numpy(zero_copy_only=False), return_counts=True)
    x, good = directions(rows, int(max(zip(times, sizes, strict=True))[1]))
    x = np.unique(x[good], axis=0)
    if not len(x):
        return np.zeros((1, int(sizes.max())))
    centres = x[:: max(1, len(x) // lists)][:lists].copy()
    for _ in range(rounds):
        at = np.concatenate([apart(x[i : i + 2048], centres).argmin(axis=1) for i in range(0, len(x), 2048)])
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        n = np.bincount(at, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def few(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of so few rows that a table of so many columns has CELLS numbers at most."""
    step = max(1, CELLS // max(1, width))
    for batch in batches:
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def _listed(centres: np.ndarray, column: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches, len(centres)):
            x, good = directions(batch.column(column), centres.shape[1])
            d = apart(x, centres)
            at = d.argmin(axis=1)
            r = d[np.arange(len(x)), at]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.where(good, at, -1).astype(np.int32)), pa.array(np.where(good, r, 0.0))], names=[*batch.schema.names, "_list", "_r"])

    return run


def listed(vectors: DataFrame, centres: np.ndarray, column: str) -> DataFrame:
    """vectors with _list, the nearest centre's (-1 without a direction), and _r, the distance from it."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.mapInArrow(_listed(centres, column), f"{schema}, _list int, _r double")


def _in_blocks(centres: np.ndarray, column: str, wanted: Callable[[np.ndarray, pa.RecordBatch], np.ndarray]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches, len(centres)):
            x, good = directions(batch.column(column), centres.shape[1])
            rows, blocks = np.nonzero(good[:, None] & wanted(apart(x, centres), batch))
            ends = np.searchsorted(rows, np.arange(len(x) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(blocks.astype(np.int32)))], names=[*batch.schema.names, "_blocks"])

    return run


def in_blocks(queries: DataFrame, centres: np.ndarray, column: str, wanted: Callable) -> DataFrame:
    """queries, one row for each block that wanted (of distances from the centres and a batch) marks, as _block.

    Tasks of Python give back numbers of blocks only; Spark copies the rows.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema)
    return queries.mapInArrow(_in_blocks(centres, column, wanted), f"{schema}, _blocks array<int>").withColumn("_block", F.explode("_blocks")).drop("_blocks")


def distance_of(score: float) -> float:
    """How far directions of this cosine are apart."""
    return float(np.sqrt(max(0.0, 2 - 2 * score)))


#: Rows of a side that are compared at a time, about.
BLOCK = 2048


def _compared(on: list[str], threshold: float, entry: str, query: str, nearest: bool, but: tuple[str, str] | None) -> Callable:
    """Pairs of a block of entries and one of queries, by products of matrices; the bounds give way by SLACK."""

    def run(entries: pa.Table, queries: pa.Table) -> pa.Table:
        of = lambda t: list(zip(*(t.column(c).to_pylist() for c in on), strict=True))
        scopes: dict[tuple, int] = {}
        a, b = (np.array([scopes.setdefault(v, len(scopes)) for v in of(t)], int) for t in (entries, queries))
        vectors = [t.column(c).combine_chunks() for t, c in ((entries, entry), (queries, query))]
        left, right = [np.zeros(0, int)], [np.zeros(0, int)]
        for size in np.unique(pc.list_value_length(vectors[1]).fill_null(0).to_numpy(zero_copy_only=False)):
            if size:
                (x, has), (y, asks) = (directions(v, int(size)) for v in vectors)
                near = np.where((b[:, None] == a) & asks[:, None] & has, y @ x.T, -np.inf)
                if but:
                    ids = [np.array(t.column(c).to_pylist(), object) for t, c in zip((entries, queries), but, strict=True)]
                    near[ids[1][:, None] == ids[0]] = -np.inf
                least = np.maximum(threshold, near.max(axis=1, initial=-np.inf)) if nearest else np.full(len(near), threshold)
                q, e = np.nonzero(near >= least[:, None] - SLACK)
                left.append(e)
                right.append(q)
        e, q = (pa.array(np.concatenate(x)) for x in (left, right))
        first, second = entries.take(e), queries.drop_columns(on).take(q)
        return pa.table([*first.columns, *second.columns], names=[*first.column_names, *second.column_names])

    return run


def pairs_within(entries: DataFrame, queries: DataFrame, on: list[str], threshold: float, entry: str, query: str, nearest: bool = False, but: tuple[str, str] | None = None) -> DataFrame:
    """Pairs of an entry and a query, equal in the columns `on`, whose cosine is the threshold or more, with score.

    Both have a vector each, in columns named `entry` and `query`. Rows are dealt out to blocks by `on`, large groups to
    several, and each two blocks that belong together are compared in one task. With nearest, pairs that another of
    the block surpasses may stay out; `but` names a column of each side, whose values have to differ.
    """
    entries, queries = (df.where(reduce(lambda x, y: x & y, (F.col(c).isNotNull() for c in on))) for df in (entries, queries))
    groups = max(1, -(-entries.count() // BLOCK))
    group = F.pmod(F.xxhash64(*on), F.lit(groups))
    blocks = lambda df: df.groupBy(group.alias("_g")).agg(F.ceil(F.count("*") / BLOCK).alias("n"))
    of = blocks(entries).withColumnRenamed("n", "_a").join(blocks(queries).withColumnRenamed("n", "_b"), "_g")
    of = F.broadcast(of)  # a row for each BLOCK entries at most

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        held = [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]
        rows = df.withColumn("_g", group).join(of, "_g").withColumn(f"{own}i", F.pmod(F.xxhash64(*held), F.col(own)))
        return rows.withColumn(f"{other}i", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))).withColumn("_unit", F.struct("_g", "_ai", "_bi")).drop("_g", "_a", "_b", "_ai", "_bi")

    fields = [*entries.schema, *(f for f in queries.schema if f.name not in on)]
    run, drop = _compared(on, threshold, entry, query, nearest, but), lambda t: t.drop_columns(["_unit"])
    asked = dealt(queries, "_b", "_a")
    # Named anew, as both sides may come of one table.
    both = dealt(entries, "_a", "_b").groupBy("_unit").cogroup(asked.toDF(*asked.columns).groupBy("_unit"))
    met = both.applyInArrow(lambda x, y: run(drop(x), drop(y)), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields))
    return met.withColumn("score", cosine(F.col(query), F.col(entry))).where(F.col("score") >= threshold)


def _usable(column: pa.ChunkedArray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the vectors with a direction, their numbers and their directions."""
    column = column.combine_chunks()
    x, good = directions(column, size)
    numbers = column.filter(pa.array(good)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.flatnonzero(good), numbers.reshape(-1, size), x[good]


def _distinct(x: np.ndarray, k: int) -> np.ndarray:
    """Places, in order, of all rows but those that k equal ones precede."""
    _, which = np.unique(np.ascontiguousarray(x).view(f"V{x.itemsize * x.shape[1]}").ravel(), return_inverse=True)
    order = np.argsort(which, kind="stable")
    before = np.arange(len(x)) - np.searchsorted(which[order], which[order])
    return np.sort(order[before < k])


def _scores(x: np.ndarray, y: np.ndarray, e: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines of rows e of x and q of y, numbers added up one by one as `cosine` does, so that they are the same to the bit."""
    dots, square, squares = np.zeros(len(e)), np.zeros(len(x)), np.zeros(len(y))
    for a, b in zip(x.T, y.T, strict=True):
        dots += a[e] * b[q]
        square += a * a
        squares += b * b
    return dots / np.sqrt(square[e] * squares[q])


def _nearest_of_block(entries: pa.Table, queries: pa.Table, key: str, vector: str, size: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of queries, places of entries and scores: the k nearest entries of each query, ties by key, without those under _least."""
    order = pc.sort_indices(entries, sort_keys=[(key, "ascending")], null_placement="at_start").to_numpy()
    at, x, along = _usable(entries.column("_v").take(pa.array(order)), size)
    some = _distinct(x, k) if len(x) else np.zeros(0, int)
    at, x, along = order[at[some]], np.asfortranarray(x[some]), along[some]
    asks, y, toward = _usable(queries.column(vector), size)
    least = queries.column("_least").to_numpy()[asks].copy()
    step = max(1, CELLS // max(1, len(x)))
    for i in range(0, len(y) if len(x) else 0, step):
        near, low = toward[i : i + step] @ along.T, least[i : i + step]
        many = np.flatnonzero((near >= low[:, None]).sum(axis=1) > k)
        if len(many):
            low[many] = np.partition(near[many], -k, axis=1)[:, -k]
        q, e = np.nonzero(near >= low[:, None] - ROUNDING)
        scores = _scores(x, y[i : i + step], e, q)
        best = np.lexsort((e, -scores, q))
        best = best[np.arange(len(q)) - np.searchsorted(q, q) < k]  # q is in order before and after
        yield asks[i + q[best]], at[e[best]], scores[best]


class VectorIndex:
    """Vectors (a key, an embedding and metadata) in lists, in one folder; a new version is switched to when it is whole.

    Vectors without a direction (null, zero, of another size, or not finite) are kept but never found.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "chunk_id", column: str = "embedding"):
        self.spark, self.path, self.key, self.column = spark, path, key, column
        fs, at = file_system(spark, path)
        found = [int(n[8:]) for s in fs.listStatus(at) if (n := s.getPath().getName()).startswith("version-") and exists(spark, f"{path}/{n}/_SUCCESS")] if fs.exists(at) else []
        self.version = max(found, default=-1)
        state = json.loads(spark.read.text(f"{path}/version-{self.version}").first()[0]) if found else {"folders": [], "centres": [[0.0]], "lists": []}
        self.folders, self.centres = state["folders"], np.array(state["centres"])
        self.sizes, self.ranges = np.zeros(len(self.centres), int), np.tile([np.inf, -np.inf], (len(self.centres), 1))
        for i, n, low, high in state["lists"]:
            self.sizes[i], self.ranges[i] = n, (low, high)
        #: Lists that the last search read, and of how many.
        self.read = (0, 0)

    @classmethod
    def build(cls, vectors: DataFrame, path: str, key: str = "chunk_id", column: str = "embedding", lists: int | None = None) -> VectorIndex:
        """Indexes every row; there are about as many lists as vectors in a list, LISTS at most."""
        index = cls(vectors.sparkSession, path, key, column)
        index.centres = centres_of(vectors, column, lists or min(LISTS, max(1, int(vectors.count() ** 0.5))))
        index.folders = []
        return index._stored(vectors)

    def add(self, vectors: DataFrame) -> VectorIndex:
        """Indexes more rows, around the centres that there are."""
        return self._stored(vectors)

    def _stored(self, vectors: DataFrame) -> VectorIndex:
        folder = uuid.uuid4().hex
        # The key is part of the order, so that equal vectors, however many, are dealt out too.
        rows = listed(vectors, self.centres, self.column).repartitionByRange("_list", "_r", self.key).sortWithinPartitions("_list", "_r")
        rows.write.option("parquet.block.size", 1 << 20).parquet(f"{self.path}/{folder}")
        self.folders = [*self.folders, folder]
        lists = self.rows().where("_list >= 0").groupBy("_list").agg(F.count("*"), F.min("_r"), F.max("_r")).collect()  # LISTS rows at most
        state = {"folders": self.folders, "centres": self.centres.tolist(), "lists": [list(r) for r in lists]}
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.text(f"{self.path}/version-{self.version + 1}")
        return VectorIndex(self.spark, self.path, self.key, self.column)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.path}/{f}" for f in self.folders))

    def top(self, query: list[float], k: int, filters: dict | None = None) -> DataFrame:
        """key and score of the k nearest, ties by key, as a scan of all rows would give them.

        Lists are read by the nearness that they allow, twice as many in each round, until the k-th is nearer than
        any list that is left could hold.
        """
        x, good = directions(pa.array([query], pa.list_(pa.float64())), self.centres.shape[1])
        d = apart(x, self.centres)[0]
        least = np.maximum(0, np.maximum(d - self.ranges[:, 1], self.ranges[:, 0] - d))
        order = [int(i) for i in np.argsort(least, kind="stable") if self.sizes[i]]
        q = F.array(*(F.lit(float(v)) for v in query))
        best, n = [], 0
        if good[0]:
            reach, step = np.inf, 1
            while n < len(order) and least[order[n]] <= reach + SLACK:
                some = [i for i in order[n : n + step] if least[i] <= reach + SLACK]
                n, step = n + len(some), 2 * step
                rows = self.rows().where(F.col("_list").isin(some))
                if np.isfinite(reach):  # of each list the ring that is within reach
                    ring = F.create_map(*(F.lit(v) for i in some for v in (i, float(d[i]))))
                    rows = rows.where(F.abs(F.col("_r") - ring[F.col("_list")]) <= reach + SLACK)
                found = metadata_filter(rows, filters).select(self.key, cosine(F.col(self.column), q).alias("score")).orderBy(F.desc("score"), self.key).limit(k).collect()
                best = sorted([*best, *found], key=lambda r: (-r.score, r[self.key]))[:k]
                if len(best) == k:
                    reach = distance_of(best[-1].score)
        self.read = (n, len(order))
        kind = self.rows().schema[self.key].dataType.simpleString() if self.folders else "string"
        return self.spark.createDataFrame([(r[self.key], float(r.score)) for r in best], f"{self.key} {kind}, score double")

    def top_each(self, queries: DataFrame, k: int, query: str = "query_id", vector: str = "vector") -> DataFrame:
        """query, key, score and rank of the k nearest of each query (query, vector), exactly; all queries at a time.

        Lists are put together to blocks, large ones dealt out to several. The block of a query's nearest list gives a
        first score; all blocks with a list that may hold a better one are compared with it then. A task compares a
        block with a part of the queries, whatever their number.
        """
        spark, sizes, ranges, centres, key, size = self.spark, self.sizes, self.ranges, self.centres, self.key, self.centres.shape[1]
        most = max(1, NUMBERS // size)
        first, parts, blocks = self._blocks(min(most, max(BLOCK, -(-int(sizes.sum()) // (4 * spark.sparkContext.defaultParallelism)))))
        asked = queries.select(query, vector)
        shares = max(1, -(-asked.count() // most))
        holds = np.zeros((len(sizes), blocks), np.float32)
        for i in np.flatnonzero(sizes):
            holds[i, first[i] : first[i] + parts[i]] = 1

        def nearest(d: np.ndarray, _: pa.RecordBatch) -> np.ndarray:
            return first[np.where(sizes, d, np.inf).argmin(axis=1)][:, None] == np.arange(blocks)

        def within_reach(d: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
            t = np.sqrt(np.maximum(0, 2 - 2 * batch.column("_least").to_numpy()))[:, None] + SLACK
            # The last bound is that of the plane midway between a list's centre and the nearest one.
            need = (sizes > 0) & (d - ranges[:, 1] <= t) & (ranges[:, 0] - d <= t) & ((d - d.min(axis=1, keepdims=True)) / 2 <= t)
            return need.astype(np.float32) @ holds > 0

        def first_score(entries: pa.Table, some: pa.Table) -> pa.Table:
            least = some.column("_least").to_numpy().copy()
            for q, _, scores in _nearest_of_block(entries, some, key, vector, size, k):
                at, n = np.unique(q, return_counts=True)
                ends = np.cumsum(n)
                least[at[n == k]] = scores[ends[n == k] - 1]
            return some.select([query, vector]).append_column("_least", pa.array(least))

        def best(entries: pa.Table, some: pa.Table) -> pa.Table:
            found = [pa.table([some.column(query).take(pa.array(q)), entries.column(key).take(pa.array(e)), pa.array(scores)], names=[query, key, "score"]) for q, e, scores in _nearest_of_block(entries, some, key, vector, size, k)]
            none = pa.table([some.column(query).slice(0, 0), entries.column(key).slice(0, 0), pa.array([], pa.float64())], names=[query, key, "score"])
            return pa.concat_tables([none, *found])

        of = F.broadcast(spark.createDataFrame([(int(i), int(first[i]), int(parts[i])) for i in np.flatnonzero(sizes)], "_list int, _block int, _parts int"))  # LISTS rows at most
        rows = self.rows().select(key, F.col(self.column).alias("_v"), "_list").join(of, "_list").withColumn("_block", F.col("_block") + F.pmod(F.xxhash64(key), "_parts"))
        unit = F.col("_block").cast("long") * shares
        entries = rows.select(key, "_v", F.explode(F.sequence(unit, unit + shares - 1)).alias("_unit")).repartition(blocks * shares, "_unit")

        def compared(rows: DataFrame, run: Callable, schema: str) -> DataFrame:
            some = rows.select(query, vector, "_least", (unit + F.pmod(F.xxhash64(query), F.lit(shares))).alias("_unit"))
            # Named anew, as both sides may come of one table; dealt out by number, as Spark would put small blocks into one task.
            some = some.toDF(*some.columns).repartition(blocks * shares, "_unit")
            return entries.groupBy("_unit").cogroup(some.groupBy("_unit")).applyInArrow(run, schema)

        kinds = {f.name: f.dataType.simpleString() for f in asked.schema} | {key: self.rows().schema[key].dataType.simpleString()}
        started = in_blocks(asked.withColumn("_least", F.lit(-2.0)), centres, vector, nearest)
        bound = compared(started, first_score, f"`{query}` {kinds[query]}, `{vector}` {kinds[vector]}, _least double")
        met = compared(in_blocks(bound, centres, vector, within_reach), best, f"`{query}` {kinds[query]}, `{key}` {kinds[key]}, score double")
        by = Window.partitionBy(query).orderBy(F.desc("score"), key)
        return met.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)

    def _blocks(self, size: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Of each list its first block and the number of its blocks, and how many blocks of so many vectors there are."""
        first, parts, blocks, room = np.zeros(len(self.sizes), int), np.ones(len(self.sizes), int), 0, 0
        for i in np.flatnonzero(self.sizes):
            n = int(self.sizes[i])
            if n > size:
                first[i], parts[i], blocks, room = blocks, -(-n // size), blocks - (-n // size), 0
            else:
                blocks, room = (blocks, room) if n <= room else (blocks + 1, size)
                first[i], room = blocks - 1, room - n
        return first, parts, max(1, blocks)
