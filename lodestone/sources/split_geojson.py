"""A reader of feature collections that splits each file over tasks.

Spark deals out the bytes of the files in blocks, in pieces that end with a closing brace, so that any file system and
size of block will do. Whether a block begins within a string or how deep it is nested shows only in what comes before
it. So each block is summed up twice, as if it began outside of a string and within one; the driver adds up the few
numbers of each block; and a second pass cuts the features out of all blocks, each of which now knows where it begins.
A feature that lies in several blocks is put together from its pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.scratch import small_side, written

#: How deep features lie: in the list of a member of the collection.
DEPTH = 2


class Marks(NamedTuple):
    """The braces and brackets of a block outside of strings."""

    at: np.ndarray
    opens: np.ndarray  # {
    closes: np.ndarray  # }
    before: np.ndarray  # depth before each, from 0 at the block's begin
    after: np.ndarray
    listed: np.ndarray  # a { that is no member's value, so that of a list


def marks(data: bytes, quotes: np.ndarray, within: bool) -> Marks:
    """What a block holds if it begins within a string, or if not; quotes are the places of its unescaped quotes."""
    b = np.frombuffer(data, np.uint8)
    at = np.flatnonzero((b | 32 == 123) | (b | 32 == 125))  # [ and ] are { and } but for one bit
    at = at[(np.searchsorted(quotes, at) + within) % 2 == 0]
    kind = b[at]
    step = np.where(kind | 32 == 123, 1, -1)
    after = np.cumsum(step)
    opens = kind == 123
    listed = np.zeros(len(at), bool)
    waiting, back = np.flatnonzero(opens), 1  # look back over white space for what comes before
    while len(waiting):
        place = at[waiting] - back
        seen = np.where(place >= 0, b[np.maximum(place, 0)], 0)
        listed[waiting] = (seen == 44) | (seen == 91)
        waiting, back = waiting[np.isin(seen, (9, 10, 13, 32))], back + 1
    return Marks(at, opens, kind == 125, after - step, after, listed)


def quotes_of(data: bytes) -> np.ndarray:
    """The places of quotes before which an even number of backslashes stands. No block ends within an escape."""
    b = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(b == 34)
    escaped, waiting, back = np.zeros(len(at), bool), np.arange(len(at)), 1
    while len(waiting):
        place = at[waiting] - back
        waiting = waiting[(place >= 0) & (b[np.maximum(place, 0)] == 92)]
        escaped[waiting] ^= True
        back += 1
    return at[~escaped]


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int, bytes]]:
    """Each block as a whole, out of its pieces, which come one after the other."""
    name, pieces = None, []
    for batch in batches:
        for source, block, value in zip(batch["_source"], batch["block"], batch["value"], strict=True):
            if name != (source, block):
                if name:
                    yield *name, b"".join(pieces)
                name, pieces = (source, block), []
            pieces += (value, b"}")
    if name:
        yield *name, b"".join(pieces)


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for source, block, data in _blocks(batches):
        quotes = quotes_of(data)
        for within in (False, True):
            m = marks(data, quotes, within)
            depth = m.before[m.opens]
            last = dict(zip(depth.tolist(), m.listed[m.opens].tolist(), strict=True))  # later ones replace earlier ones
            found, n = np.unique(m.before[m.listed], return_counts=True)
            yield pd.DataFrame([{"_source": source, "block": block, "within": within, "flips": bool(len(quotes) % 2), "rise": int(m.after[-1]) if len(m.at) else 0,
                "found": dict(zip(found.tolist(), n.tolist(), strict=True)), "last": last}])


class Begin(NamedTuple):
    """How a block begins: within a string, so deep, after so many features, and within a feature."""

    within: bool
    depth: int
    n: int
    cut: bool


def begins(pieces: DataFrame) -> dict[tuple[str, int], Begin]:
    """How each block begins. A few numbers of each block pass through the driver, which holds the list of blocks anyway."""
    schema = "_source string, block long, within boolean, flips boolean, rise long, found map<long,long>, last map<long,boolean>"
    sums: dict[str, dict[int, dict[bool, object]]] = {}
    for r in pieces.mapInPandas(_summed, schema).collect():
        sums.setdefault(r._source, {}).setdefault(r.block, {})[r.within] = r
    out = {}
    for source, blocks in sums.items():
        now, listed = Begin(False, 0, 0, False), False
        for block in sorted(blocks):
            out[source, block] = now
            r = blocks[block][now.within]
            listed = dict(r.last).get(DEPTH - now.depth, listed)
            depth = now.depth + r.rise
            now = Begin(now.within != r.flips, depth, now.n + dict(r.found).get(DEPTH - now.depth, 0), listed and depth > DEPTH)
    return out


def _cut(known: dict[tuple[str, int], Begin]):
    """Rows (n, block, whole, value) of the features and parts of features of each block; n is -1 for the text around them."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for source, block, data in _blocks(batches):
            begin = known[source, block]
            m = marks(data, quotes_of(data), begin.within)
            starts = m.at[m.listed & (m.before == DEPTH - begin.depth)]
            ends = m.at[m.closes & (m.after == DEPTH - begin.depth)] + 1
            closing = m.at[m.closes & (m.after == -begin.depth)]  # the collection's end; a brace too many may follow
            stop = int(closing[0]) + 1 if len(closing) else len(data)
            rows, around, at = [], [], 0
            spans = [(0, begin.n - 1)] if begin.cut else []
            for i, (start, n) in enumerate([*spans, *((int(s), begin.n + j) for j, s in enumerate(starts))]):
                k = int(np.searchsorted(ends, start, "right"))
                end = int(ends[k]) if k < len(ends) else len(data)
                around.append(data[at:start])
                rows.append((source, n, block, k < len(ends) and not (begin.cut and not i), data[start:end]))
                at = end
            around.append(data[at:stop])
            rest = b"".join(x for x in around if x.strip() not in (b"", b","))
            if rest:
                rows.append((source, -1, block, False, rest))
            for i in range(0, len(rows), 10_000):
                yield pd.DataFrame(rows[i : i + 10_000], columns=["_source", "n", "block", "whole", "value"])

    return cut


def split_collections(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(_source, _src_index, value) of all features as JSON texts, and (_source, value) of the collections without them.

    The blocks are as large as spark.sql.files.maxPartitionBytes says; a task holds one at a time. An empty file is an
    error. Compressed files can't be split, and are read by a task each.
    """
    raw = spark.read.option("lineSep", "}").text(path)
    pieces = raw.select(F.col("_metadata.file_path").alias("_source"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    known = begins(pieces)
    files, read = set(raw.inputFiles()), {source for source, _ in known}
    if len(files) > len(read):  # Spark plans no task for empty files
        names = {f.rsplit("/", 1)[-1] for f in files} - {f.rsplit("/", 1)[-1] for f in read}
        raise ValueError(f"empty files: {', '.join(sorted(names)) or len(files) - len(read)}")
    cut = written(pieces.mapInPandas(_cut(known), "_source string, n long, block long, whole boolean, value binary"), "features")
    joined = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("block", "value"))), lambda p: p.value.cast("string")))
    text = F.col("value").cast("string")
    # UTF-8 is cut between characters only, as pieces begin and end at braces.
    features = cut.where("n >= 0 and whole").select("_source", "n", text.alias("value")).unionByName(cut.where("n >= 0 and not whole").groupBy("_source", "n").agg(joined.alias("value")))
    return features.withColumnRenamed("n", "_src_index"), cut.where("n < 0").groupBy("_source").agg(joined.alias("value"))


def with_collections(features: DataFrame, around: DataFrame) -> DataFrame:
    """features joined to what their collection has besides them, a row for each file."""
    return features.join(small_side(around), "_source")
