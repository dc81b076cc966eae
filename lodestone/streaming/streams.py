"""Streaming forms of the log sink and of the result cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lodestone.functions.text import duration_ms
from lodestone.operators.state import module_tag
from lodestone.scratch import exists, file_system, remove


def log_records(events: DataFrame) -> DataFrame:
    """Log rows of a stream (ts, logger, level, message) with module and duration_ms."""
    return events.withColumn("module", module_tag(F.col("logger"))).withColumn("duration_ms", duration_ms(F.col("message")))


def log_sink(events: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Appends log rows to Parquet by day, exactly once; without `every` it takes what is there and ends."""
    writer = log_records(events).withColumn("day", F.to_date("ts")).writeStream.format("parquet").partitionBy("day").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows, sum and mean of value by window and module; rows later than `late` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "module").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "module", "n", "total")


#: Parts into which the keys of an upserted table are dealt.
PARTS = 64


def _manifest(spark: SparkSession, path: str, below: int | None = None) -> dict[int, int]:
    """The batch that wrote each part last, of batches below a number; the batch of the largest number counts."""
    if not exists(spark, f"{path}/_manifests"):
        return {}
    fs, at = file_system(spark, f"{path}/_manifests")
    numbers = [int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit() and exists(spark, f"{s.getPath()}/_SUCCESS")]
    numbers = [n for n in numbers if below is None or n < below]
    if not numbers:
        return {}
    return {r.part: r.batch for r in spark.read.json(f"{path}/_manifests/{max(numbers)}", schema="part int, batch long").collect()}  # PARTS rows


def _read_parts(spark: SparkSession, path: str, parts: dict[int, int], schema: StructType) -> DataFrame:
    """The rows of parts, each from the batch that wrote it last."""
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{path}/{batch}/_part={part}" for part, batch in sorted(parts.items())))


def read_upserted(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table that upsert_latest keeps, as its last whole batch left it."""
    return _read_parts(spark, path, _manifest(spark, path), schema)


def upsert_latest(stream: DataFrame, path: str, checkpoint: str, key: str, version: str) -> StreamingQuery:
    """Keeps the last version of each key.

    Keys are dealt into PARTS; a batch rewrites the parts whose keys it has, into a folder of its own, and its
    manifest then says which batch wrote each part last. A batch that runs again writes the same anew. Parts that no
    manifest but the last two names are removed.
    """
    from lodestone.operators.retrieval import latest

    part = F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _manifest(spark, path, number)
        rows = batch.withColumn("_part", part)
        touched = {r[0] for r in rows.select("_part").distinct().collect()}  # PARTS at most
        old = _read_parts(spark, path, {p: b for p, b in before.items() if p in touched}, batch.schema)
        latest(old.unionByName(batch), key, version).withColumn("_part", part).repartition(F.col("_part")).write.mode("overwrite").partitionBy("_part").parquet(f"{path}/{number}")
        now = before | dict.fromkeys(touched, number)
        if not now:
            return
        spark.createDataFrame(list(now.items()), "part int, batch long").coalesce(1).write.mode("overwrite").json(f"{path}/_manifests/{number}")
        for p, b in _manifest(spark, path, max(before.values(), default=0)).items():
            if before.get(p) != b and now[p] != b:
                remove(spark, f"{path}/{b}/_part={p}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
