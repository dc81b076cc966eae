"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.scratch import BROADCAST_ROWS, cleared, remove, scratch, shared_dir, small_side, written
from lodestone.sources.documents import spread

__all__ = ["BROADCAST_ROWS", "SLICE_BYTES", "UPPER", "ascii_lower", "cleared", "remove", "scratch", "shared_dir", "slices", "small_side", "table", "utf8", "written"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Bytes of text that a Python helper takes at once.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that each holds SLICE_BYTES of the column or one row."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if i > start and total + size > SLICE_BYTES:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if len(sizes) > start:
            yield batch.slice(start)


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
