"""Chunks of documents: by headings, or by a recursive split of long texts."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import context_prefix, looks_like_heading

SIZE, OVERLAP = 800, 120
#: Texts that are cut and given back at a time, so that a batch is not held with all of its pieces.
ROWS = 64
# Separators from coarse to fine.
SEPARATORS = ("\n\n", "\n", ". ", "! ", "؟ ", "? ", "؛ ", "; ", ", ", " ", "")


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most size characters where a separator allows it; each begins with the end of the one before.

    The text is cut at the coarsest separator that it has; parts that are still too long are cut at finer ones.
    """
    if not text.strip():
        return []
    sep = next((s for s in separators if s == "" or s in text), "")
    finer = separators[separators.index(sep) + 1 :]
    cut = text.split(sep) if sep else list(text)
    parts = [cut[0], *(sep + p for p in cut[1:])]
    out: list[str] = []
    held: deque[str] = deque()
    size_held = 0

    def flush() -> None:
        if piece := "".join(held).strip():
            out.append(piece)

    for part in parts:
        if len(part) > size and finer:
            flush()
            held.clear()
            size_held = 0
            out += split_text(part, size, overlap, finer)
            continue
        if held and size_held + len(part) > size:
            flush()
            while held and (size_held > overlap or size_held + len(part) > size):
                size_held -= len(held.popleft())
        held.append(part)
        size_held += len(part)
    flush()
    return out


def recursive_chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, chunk_index and text of each piece of docs (doc_id of any type, text); null and blank texts have none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, max(b.num_rows, 1), ROWS)):
            made = [split_text(t, size, overlap) if t else [] for t in batch.column("text").to_pylist()]
            counts = [len(x) for x in made]
            of = pa.array(np.repeat(np.arange(len(made)), counts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(of), pa.array([i for n in counts for i in range(n)], pa.int32()), pa.array([x for pieces in made for x in pieces], pa.string())],
                names=["doc_id", "chunk_index", "text"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, chunk_index int, text string")


def sections(docs: DataFrame) -> DataFrame:
    """doc_id, section_index, section and body of each heading with a body; what stands before the first heading goes."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    head = looks_like_heading(F.col("line"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    marked = lines.withColumn("n", F.sum(head.cast("int")).over(w)).withColumn("head", head).where("n > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("head") & (F.trim("line") != ""), F.struct("pos", F.trim("line").alias("line"))))), lambda x: x.line), "\n")
    made = marked.groupBy("doc_id", "n").agg(F.max(F.when(F.col("head"), F.trim("line"))).alias("section"), body.alias("body")).where("body != ''")
    return made.select("doc_id", F.col("n").cast("int").alias("section_index"), "section", "body")


def section_units(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """document_id, page_number, piece, section and text of the chunks of pages (document_id, page_number, text).

    A page of two sections or more gives a chunk a section, its heading before it; a section that is too long is
    split and each piece gets the heading. Other pages are split as they are and have no section.
    """
    key = F.struct("document_id", "page_number")
    found = sections(pages.select(key.alias("doc_id"), "text"))
    several = found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    found = found.join(several, "doc_id").withColumn("text", context_prefix(F.col("section"), F.trim("body")))
    whole = found.where(F.length("text") <= size).select("doc_id", "section_index", F.lit(0).alias("chunk_index"), "section", "text")
    long = found.where(F.length("text") > size).select(F.struct("doc_id", "section_index", "section").alias("doc_id"), F.col("body").alias("text"))
    cut = recursive_chunks(long, size, overlap).select("doc_id.*", "chunk_index", context_prefix(F.col("doc_id.section"), F.col("text")).alias("text"))
    plain = pages.select(key.alias("doc_id"), "text").join(several, "doc_id", "left_anti")
    plain = recursive_chunks(plain, size, overlap).select("doc_id", F.lit(0).alias("section_index"), "chunk_index", F.lit(None).cast("string").alias("section"), "text")
    units = whole.unionByName(cut).unionByName(plain)
    return units.select("doc_id.document_id", "doc_id.page_number", F.struct("section_index", "chunk_index").alias("piece"), "section", "text")


def chunk_id(document: Column, page: Column, text: Column) -> Column:
    """`<document>-` and 16 hex digits of the hash of document, page and text."""
    doc = document.cast("string")
    return F.concat(doc, F.lit("-"), F.substring(F.sha1(F.concat_ws(":", doc, page.cast("string"), text)), 1, 16))


def page_chunks(chunks: DataFrame) -> DataFrame:
    """chunks with chunk_id and chunk_index, counted over all pages of a document from 0."""
    order = Window.partitionBy("document_id").orderBy("page_number", "piece")
    return chunks.withColumn("chunk_index", F.row_number().over(order) - 1).withColumn("chunk_id", chunk_id(F.col("document_id"), F.col("page_number"), F.col("text")))


def chunk_pages(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """The chunks of whole documents: section_units with their ids and places."""
    return page_chunks(section_units(pages, size, overlap))


def citations(hits: DataFrame) -> DataFrame:
    """The places that hits (title, source, page_number, chunk_id) come from, each once."""
    return hits.select("title", "source", "page_number", "chunk_id").distinct()
