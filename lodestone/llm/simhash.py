"""SimHash near-duplicates, linked by anchor-point covering.

A fingerprint is split into its two 32-bit halves. Two fingerprints that differ in at most 4 bits differ in at
most 2 bits in one half. The anchors of a half are the words of the [31, 26] Hamming code, laid over its first 31
bits: a perfect covering code of radius 1. Halfway between two halves that are 2 bits apart lies a point that is
at most 1 bit from both, and that point has an anchor at most 1 bit away. So a fingerprint is copied to every
anchor within the covering radius plus half of the threshold of its half, 2 bits, and each linked pair meets at
one anchor at least. That is 16 anchors a half (1 where the half is itself a word of the code).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import BROADCAST_ROWS, slices, utf8, written

#: Words of a shingle, and the largest number of differing bits of a link.
SHINGLE, THRESHOLD = 4, 4
#: Fingerprints of one anchor that one task compares with each other; larger crowds are compared block by block.
BLOCK = 2048
_HALF = (1 << 31) - 1


def fingerprint(text: bytes) -> int:
    """The unsigned 64-bit fingerprint; 0 where there is no word."""
    words = text.lower().split()  # bytes: A-Z only, and the six ASCII white-space characters only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], dtype="<u8")
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends]
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a : b - 1], 42) for a, b in zip(starts, ends[SHINGLE - 1 :], strict=False)), "<u8", len(words) - SHINGLE + 1)
    set_in = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)])
        set_in += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_in * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = np.array([fingerprint(t) for t in utf8(batch.column("text"))], dtype=np.uint64)
        more = batch.schema.names[2:]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64)), *map(batch.column, more)], names=["doc_id", "fp", *more])


def fingerprints(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and more, strings, of each row of docs."""
    rows = docs.select("doc_id", "text", *more)
    return rows.mapInArrow(_fingerprints, ", ".join([f"doc_id {docs.schema['doc_id'].dataType.simpleString()}", "fp long", *(f"{c} string" for c in rows.columns[2:])]))


def _flips() -> list[tuple[int, int]]:
    """(syndrome, bits to flip) from a point to each anchor within 2 bits; bit i-1 has the check value i."""
    out = [(0, 0)]
    for s in range(1, 32):
        out.append((s, 1 << (s - 1)))
        out += [(s, 1 << (i - 1) | 1 << ((i ^ s) - 1)) for i in range(1, 32) if i < i ^ s]
    return out


def anchors(nodes: DataFrame) -> DataFrame:
    """A row (anchor, fp) for each anchor near a half of each fingerprint."""
    spark = nodes.sparkSession
    flips = spark.createDataFrame(_flips(), "syndrome int, flip long")  # 497 rows, whatever the input
    halves = nodes.select("fp", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("fp").bitwiseAND(F.lit(_HALF)).alias("bits")),
        F.struct(F.lit(1).alias("side"), F.shiftrightunsigned("fp", 32).bitwiseAND(F.lit(_HALF)).alias("bits")),
    )).alias("half")).select("fp", "half.*")
    syndrome = F.lit(0)
    for k in range(5):
        checks = sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1)
        syndrome = syndrome + (F.bit_count(F.col("bits").bitwiseAND(F.lit(checks))) % 2) * (1 << k)
    return halves.withColumn("syndrome", syndrome.cast("int")).join(F.broadcast(flips), "syndrome").select(
        (F.col("side").cast("long") * (1 << 31) + F.col("bits").bitwiseXOR(F.col("flip"))).alias("anchor"), "fp"
    )


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between the fingerprints (unsigned, distinct)."""
    edges: list[tuple[int, int]] = []
    rest = fps
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            near = np.bitwise_count(rest ^ at) <= THRESHOLD
            if near.any():
                found = rest[near]
                edges += [(int(at), int(x)) for x in found]
                front += list(found)
                rest = rest[~near]
    return edges


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor, lo and hi; a crowd may lie across batches."""

    def out(keys: np.ndarray, fps: np.ndarray, last: bool):
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        starts, ends = [0, *cuts], [*cuts, len(fps)]
        if not last:
            starts, ends = starts[:-1], ends[:-1]
        found: list[tuple[int, int]] = []
        for a, b in zip(starts, ends, strict=True):
            if b - a == 2:
                x, y = int(fps[a]), int(fps[a + 1])
                if (x ^ y).bit_count() <= THRESHOLD:
                    found.append((x, y))
            elif b - a > 2:
                found += forest(fps[a:b])
        pairs = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"]), (0 if last or not len(cuts) else int(cuts[-1]))

    keys, fps = np.empty((0, 3), np.int64), np.empty(0, np.uint64)
    for batch in batches:
        more = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("anchor", "lo", "hi")], axis=1)
        keys, fps = np.concatenate([keys, more]), np.concatenate([fps, batch.column("fp").to_numpy().view(np.uint64)])
        if len(fps):
            made, at = out(keys, fps, False)
            yield made
            keys, fps = keys[at:], fps[at:]
    if len(fps):
        yield out(keys, fps, True)[0]


def links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) that join all fingerprints that are linked at all; nodes: distinct fp.

    Crowds of an anchor over BLOCK fingerprints are dealt into blocks and each pair of blocks is compared apart, so
    no task holds more than about two blocks, and only a spanning forest of each comparison is kept.
    """
    near = anchors(nodes)
    # Written first: Spark can split a frequent key only where no aggregation of it is joined.
    sizes = written(near.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "crowds")
    crowds = near.join(sizes, "anchor").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    mine = crowds.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    pairs = mine.select("anchor", "fp", "own", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("own")))).alias("other"))
    dealt = pairs.select("anchor", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
    return dealt.repartition("anchor", "lo", "hi").sortWithinPartitions("anchor", "lo", "hi", "fp").mapInArrow(_links, "a long, b long").distinct()


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, root) of each node of edges (a, b), where root is the smallest node of its component.

    Alternates large-star and small-star steps; each round is written to the shared folder. An error if they have
    not ended after `rounds`; the logarithm of the largest component is what they need.
    """
    def marked(df: DataFrame, round_: int) -> tuple[DataFrame, tuple]:
        kept = written(df, f"components-{round_}")
        return kept, tuple(kept.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def apart(df: DataFrame, name: str) -> DataFrame:
        """A table of its own where a node may have more edges than a task should read, so that Spark can split it."""
        return written(df, name) if mark[0] > BROADCAST_ROWS else df

    now, mark = marked(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), 0)
    for round_ in range(1, rounds + 1):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = apart(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"least-{round_}")
        large = both.join(low, "a").where("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = apart(large.distinct(), f"large-{round_}")
        low = apart(large.groupBy("a").agg(F.min("b").alias("m")), f"least-large-{round_}")
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        now, new = marked(small.where("a != b").distinct(), round_)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components are unfinished after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _rooted(prints: DataFrame, first: Column) -> DataFrame:
    """fp, first (the least of its rows) and root of each distinct fingerprint; linked ones have the same root."""
    nodes = written(prints.groupBy("fp").agg(F.min(first).alias("first")), "nodes")
    roots = components(links(nodes.select("fp")))
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest linked doc_id) of each row of docs.

    Null, empty and blank texts have fingerprint zero and are linked like any other. Rows without doc_id keep their
    fingerprint and take part in links, but name no component unless no other row does (then it is null). Repeated
    rows give repeated results. An empty table gives no row. Other columns of docs are not looked at.
    """
    prints = written(fingerprints(docs), "fingerprints")
    named = _rooted(prints, F.col("doc_id"))
    first = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of = named.join(first, "root").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest doc_id, null ones last, and of rows with
    the same doc_id the one whose text has the smallest SHA-256.

    Rows without doc_id are documents like any other, and so are rows with the same doc_id and different texts: each
    may be the first of its group. A null text counts as empty.
    """
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    prints = written(fingerprints(docs, digest.alias("digest")), "fingerprints")
    first = _rooted(prints, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).groupBy("root").agg(F.min("first").alias("f"))
    # One key of id and text, so that the join and the removal of repeated rows share a shuffle.
    key = lambda id_, text: F.concat_ws(":", F.when(id_.isNull(), "none").otherwise(F.concat(F.lit("id "), id_.cast("string"))), text)
    keep = first.select(key(F.col("f.doc_id"), F.col("f.digest")).alias("_key"))
    return docs.withColumn("_key", key(F.col("doc_id"), digest)).join(keep, "_key", "left_semi").dropDuplicates(["_key"]).select(*docs.columns)

