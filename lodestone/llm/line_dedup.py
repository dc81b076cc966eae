"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches of ascending doc_id. The runs hold the hashes of all keys of earlier batches, bucketed and
sorted in one file a bucket, so that a batch is merge-anti-joined against each of them without moving or sorting it
again; what is new becomes a run of the lowest level. FAN_IN runs of a level are compacted into one of the next, bucket
by bucket, which moves no key either. A manifest in the runs' folder lists them by level, so that a later call goes on where an earlier one ended.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import ascii_lower, scratch, written

#: Shorter keys are never dropped. Batches of one call, runs of a level that are compacted.
MIN_KEY, BATCHES, FAN_IN = 10, 4, 3
_SPACE = " \t\n\x0b\x0c\r"
_KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return ascii_lower(F.trim(line, F.lit(_SPACE)))


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, tag (hash of the text), pos and the two hashes of each line whose key is long enough."""
    lines = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("tag"), F.posexplode(text_lines(F.col("text"))).alias("pos", "line"))
    keys = lines.where(F.length("line") >= MIN_KEY).select("doc_id", "tag", "pos", line_key(F.col("line")).alias("key"))
    return keys.where(F.length("key") >= MIN_KEY).select("doc_id", "tag", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


class LevelledRuns:
    """Sorted, bucketed tables of line hashes in levels, in a folder that a later session can open again."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch(spark, "line-runs")
        # One sorted file a bucket is read in its order; Spark asks for this setting to rely on it.
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
        self.levels, self.buckets, self.number = [[]], int(spark.conf.get("spark.sql.shuffle.partitions")), 0
        self.known: set[str] = set()
        fs, at = self._fs()
        found = [int(n.split("-")[1]) for s in fs.listStatus(at) if (n := s.getPath().getName()).startswith("manifest-") and fs.exists(self._fs(f"{n}/_SUCCESS")[1])] if fs.exists(at) else []
        if found:
            self.number = max(found)
            last = json.loads(spark.read.text(f"{self.path}/manifest-{self.number}").first()[0])
            self.levels, self.buckets = last["levels"], last["buckets"]

    def _fs(self, name: str = ""):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _write(self, keys: DataFrame) -> str:
        """Writes keys that are dealt into the buckets already, so that each bucket is one file."""
        name = f"line_run_{uuid.uuid4().hex}"
        keys.write.bucketBy(self.buckets, *_KEY).sortBy(*_KEY).option("path", f"{self.path}/{name}").saveAsTable(name)
        self.known.add(name)
        return name

    def _table(self, name: str) -> DataFrame:
        """The run as a bucketed table; those of an earlier session are named to the catalog first."""
        if name not in self.known:
            keys = f"{', '.join(_KEY)}"
            self.spark.sql(f"create table if not exists {name} (h1 bigint, h2 bigint) using parquet clustered by ({keys}) sorted by ({keys}) into {self.buckets} buckets location '{self.path}/{name}'")
            self.known.add(name)
        return self.spark.table(name).select(*_KEY)

    def runs(self) -> list[DataFrame]:
        return [self._table(name) for level in self.levels for name in level]

    def fresh(self, keys: DataFrame) -> DataFrame:
        """The keys that no run holds."""
        if self.buckets != int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            keys = keys.repartition(self.buckets, *_KEY)
        return reduce(lambda df, run: df.join(run.hint("merge"), _KEY, "left_anti"), self.runs(), keys)

    def add(self, keys: DataFrame) -> DataFrame:
        """Writes the keys, with what else they have, as a run, and gives them as a plain table."""
        name = self._write(keys.repartition(self.buckets, *_KEY))
        self.levels[0].append(name)
        for at, level in enumerate(self.levels):
            if len(level) < FAN_IN:
                break
            # No key is in two runs; asking for distinct ones has Spark read them bucket by bucket.
            merged = self._write(reduce(DataFrame.unionByName, map(self._table, level)).distinct())
            self.levels[at] = []
            if at + 1 == len(self.levels):
                self.levels.append([])
            self.levels[at + 1].append(merged)
        return self.spark.read.schema(keys.schema).parquet(f"{self.path}/{name}")

    def save(self) -> None:
        """Writes the manifest of the runs as they are now; the one of the highest number counts."""
        self.number += 1
        self.spark.createDataFrame([(json.dumps({"levels": self.levels, "buckets": self.buckets}),)], "value string").coalesce(1).write.text(f"{self.path}/manifest-{self.number}")

    def forget(self) -> None:
        """Takes the runs out of the catalog; their files stay."""
        for name in self.known:
            self.spark.sql(f"drop table if exists {name}")
        self.known = set()


def _bounds(docs: DataFrame, batches: int) -> list:
    if batches < 2:
        return []
    cuts = docs.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()[0]
    return sorted(set(cuts or []))


def dropped_lines(docs: DataFrame, batches: int = BATCHES, store: str | None = None) -> DataFrame:
    """doc_id, tag and pos of each line that an earlier document holds already.

    store: a folder of runs; a key of documents of earlier calls with it is dropped throughout, and the keys of these
    documents are added. Null and empty texts have one empty line, too short to go; rows without doc_id drop nothing
    and hold nothing; repeated rows are one document; an empty table gives no row.
    """
    runs, parts = LevelledRuns(docs.sparkSession, store), []
    cuts = _bounds(docs, batches)
    doc = F.col("doc_id")
    try:
        for low, high in zip([None, *cuts], [*cuts, None], strict=True):
            within = (F.lit(True) if low is None else doc > low) & (F.lit(True) if high is None else doc <= high)
            lines = written(hashed_lines(docs.where(within)), "lines")
            keys = lines.groupBy(*_KEY).agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"))
            later = bool(runs.runs())
            fresh = runs.add(runs.fresh(keys))
            # A key of an earlier batch is dropped throughout, a fresh one in all documents but its first.
            repeated = fresh.where("owner < last").select(*_KEY, "owner")
            if later:
                repeated = repeated.unionByName(keys.join(fresh, _KEY, "left_anti").select(*_KEY, F.lit(None).cast(docs.schema["doc_id"].dataType).alias("owner")))
            gone = lines.join(repeated, _KEY).where("owner is null or doc_id > owner")
            parts.append(written(gone.select("doc_id", "tag", "pos"), "gone"))
        if store:
            runs.save()
    finally:
        runs.forget()
    return reduce(DataFrame.unionByName, parts)


def without_repeats(docs: DataFrame, batches: int = BATCHES, store: str | None = None, counts: tuple[str, str] | None = ("n_lines", "n_dropped")) -> DataFrame:
    """docs with text less its repeated lines, and with the columns of counts at the end: lines before, and dropped.

    A null or empty text is one empty line. A line goes if its key has MIN_KEY code points or more and a document of
    smaller doc_id holds that key; within the first document all its lines stay. Rows without doc_id keep every line
    and take none from others. Rows of the same doc_id are one document. An empty table gives no row. Columns of
    docs with the names of counts are replaced; with counts None all columns of docs stay as they are, but for text.
    store: as for dropped_lines.
    """
    gone = dropped_lines(docs, batches, store).groupBy("doc_id", "tag").agg(F.collect_set("pos").alias("gone at"))
    held = docs.withColumn("row tag", F.xxhash64("text"))
    rows = held.join(gone.withColumnsRenamed({"doc_id": "gone id", "tag": "gone tag"}), (F.col("doc_id") == F.col("gone id")) & (F.col("row tag") == F.col("gone tag")), "left").select(
        *(f"`{c}`" for c in docs.columns), "gone at"
    )
    lines = text_lines(F.col("text"))
    rows = rows.withColumn("all lines", lines)
    stay = F.array_except(F.sequence(F.lit(0), F.size("all lines") - 1), F.col("gone at"))
    kept = F.when(F.col("gone at").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get("all lines", i)), "\n"))
    numbers = dict(zip(counts or (), (F.size("all lines").cast("long"), F.coalesce(F.size("gone at"), F.lit(0)).cast("long")), strict=False))
    return rows.withColumns({"text": kept} | numbers).select(*docs.columns, *(c for c in numbers if c not in docs.columns))


def line_digests(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of each row of docs."""
    rows = without_repeats(docs.select("doc_id", "text"), batches)
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
