"""A corpus pipeline of five operators, from raw documents to token ids.

STAGES holds (name, function) pairs in order. Each function takes the documents that its predecessor kept; all but
the last give back documents with the columns they came with, whatever further columns these have.

All stages take a null text for an empty one, judge rows without doc_id and rows of one doc_id with different texts
each by its own text, and give nothing for an empty table. Repeated rows stay or go together, but for the near-dedup,
of which one row of each group is left.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import byte_bpe, decontamination, line_dedup, quality, simhash
from lodestone.llm.common import cleared, remove, scratch, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects; equal texts have equal scores."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes away lines that an earlier document holds; n_chars, where there is one, is counted anew.

    A text may become empty; its document stays. Rows without doc_id keep all lines.
    """
    left = line_dedup.without_repeats(docs, counts=None)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near duplicates: smallest doc_id, null ones last, ties by a hash of the text."""
    return simhash.first_of_each(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which benchmark passages stand."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes the texts: counts and digests of each."""
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", good),
    ("line dedup", fresh_lines),
    ("SimHash near-dedup", one_of_each),
    ("benchmark decontamination", uncontaminated),
    ("byte-level BPE", encoded),
]

#: The classifier, the fingerprints and the merges have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage writes besides its result is removed when it ends, its input after it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch(spark, name.replace(" ", "-"))
        with cleared(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.schema(out.schema).parquet(path), path
    return docs
