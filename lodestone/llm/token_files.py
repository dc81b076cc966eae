"""Token ids in Parquet: list columns with dictionary or delta encoding, small row groups and page indexes.

Documents are range-partitioned by doc_id, encoded in that order and written as one file for each range. A reader
that wants only doc_id and n_tokens never touches the pages of the ids, and one that wants a few documents finds
their row groups and pages by the minimum and maximum of doc_id.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import slices, utf8

END_ID = 1
#: Bytes of a row group and of a page, rows of a page.
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 16 << 20, 64 << 10, 1000
#: Words whose ids a worker keeps; beyond it starts over.
MEMO_WORDS = 400_000


def _byte_letters() -> str:
    """The character that a byte-level vocabulary writes for each byte: itself if printable, else the next from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return "".join(chr(b if b in own else next(rest)) for b in range(256))


class Words(dict):
    """The ids of words as bytes; a word that is asked for the first time is encoded, and beyond `most` all are forgotten."""

    #: a-z and the small letters of Latin-1, which neither lower-casing nor composition changes.
    _PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")

    def __init__(self, tokenizer, most: int):
        self.tokenizer, self.most, self.letters = tokenizer, most, str.maketrans(dict(enumerate(_byte_letters())))

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.most:
            self.clear()
        if self._PLAIN.fullmatch(word):
            ids = [t.id for t in self.tokenizer.model.tokenize(word.decode("latin-1").translate(self.letters))]
        else:
            ids = self.tokenizer.encode_batch_fast([word.decode()], add_special_tokens=False)[0].ids
        self[word] = out = pack(f"<{len(ids)}i", *ids)
        return out


class WordEncoder:
    """Encodes text with a tokenizers file; the ids of each word are kept for its next use.

    The tokenizer drops white space and no token or pattern of it reaches across, so a text's ids are those of its
    words one after the other. It lower-cases by itself, so A-Z is lower-cased before; and between a letter or digit
    and a mark other than the apostrophe a piece always ends, so a space is put there. Both leave fewer words to
    learn. Words of plain small letters go to the BPE model at once, others to the library.
    """

    #: A mark with a letter or digit before it.
    _END = re.compile(rb"[!-&(-/:-@\[-`{-~](?:(?<=[a-z0-9].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))")

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        from tokenizers import Tokenizer

        self.memo = Words(Tokenizer.from_file(path), memo_words)
        # What the rules above rest on, asked of the tokenizer itself.
        ids = lambda text: self.memo.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        for text, same in ((" Ab\tC\n", "ab c"), ("abc.", "abc ."), ("x1!", "x1 !")):
            if ids(text) != ids(same):
                raise ValueError(f"{path} is no tokenizer of lower-cased words without white space")

    def words(self, text: bytes) -> list[bytes]:
        return (text if b"<|" in text else self._END.sub(rb" \g<0>", text.lower())).split()

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.frombuffer(b"".join(map(self.memo.__getitem__, self.words(t))), dtype="<i4") for t in texts]

    def counts(self, texts: list[bytes]) -> list[int]:
        """The number of ids of each text."""
        return [sum(map(len, map(self.memo.__getitem__, self.words(t)))) // 4 for t in texts]


@lru_cache(2)
def encoder_of(path: str) -> WordEncoder:
    """The encoder of a file, with what it has learned in earlier tasks of this worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path)


def _encoder(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder_of(path)
        for batch in slices(batches):
            ids = of(utf8(batch.column("text")))
            ends = np.cumsum([0, *(len(x) + 1 for x in ids)], dtype=np.int32)
            values = np.full(ends[-1], END_ID, np.int32)
            for at, x in zip(ends.tolist(), ids, strict=False):
                values[at : at + len(x)] = x
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(np.diff(ends).astype(np.int64))], names=["doc_id", "ids", "n_tokens"])

    return encode


def write_tokens(docs: DataFrame, path: str, tokenizer: str, encoding: str = "dictionary") -> None:
    """Writes doc_id, ids and n_tokens of docs in ascending doc_id order; encoding: dictionary or delta.

    A null text counts as empty, an empty one has the end id alone. Null doc_ids come first; rows with the same
    doc_id stand next to each other, ordered by the hash of their text. An empty table gives files without rows.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding is dictionary or delta, not {encoding}")
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").withColumn("tie", F.xxhash64("text")).sortWithinPartitions("doc_id", "tie")
    kind = docs.schema["doc_id"].dataType.simpleString()
    ordered.select("doc_id", "text").mapInArrow(_encoder(tokenizer), f"doc_id {kind}, ids array<int>, n_tokens long").write.options(**{
        "parquet.block.size": ROW_GROUP_BYTES, "parquet.page.size": PAGE_BYTES, "parquet.page.row.count.limit": PAGE_ROWS,
        "parquet.enable.dictionary": str(encoding == "dictionary").lower(), "parquet.writer.version": "PARQUET_1_0" if encoding == "dictionary" else "PARQUET_2_0",
        "compression": "zstd",
    }).parquet(path)


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files with the file's number and the place in it; numbers go up in the order of the ids."""
    return spark.read.parquet(path).select("*", F.element_at(F.split(F.col("_metadata.file_name"), "-"), 2).cast("long").alias("file"), F.col("_metadata.row_index").alias("at"))


def _starts(placed: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (with file, at and n_tokens) with start, the number of ids before; placed gives the totals of the files."""
    totals = placed.groupBy("file").agg(F.sum("n_tokens").alias("total"))  # a row for each file
    before = totals.select("file", (F.sum("total").over(Window.orderBy("file")) - F.col("total")).alias("before"))
    running = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("at")) - F.col("n_tokens")
    return rows.withColumn("start", running).join(before, "file").withColumn("start", F.col("start") + F.col("before"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids, n_tokens and start: the number of ids before the document, counted over the files in order.

    Rows come as they were written: null doc_ids first, repeated rows as often as they stood there, none for an empty
    table. Every row has the end id at least.
    """
    placed = _placed(spark, path)
    starts = _starts(placed, placed.select("file", "at", "n_tokens")).select("file", "at", "start")
    return placed.join(starts, ["file", "at"]).select("doc_id", "ids", "n_tokens", "start")


def _crc32(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        at, values = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4")
        sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("at"), batch.column("doc_id"), batch.column("n_tokens"), pa.array(sums, pa.int64())], names=["file", "at", "doc_id", "n_tokens", "ids_crc32"])


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, read back from the files."""
    placed = _placed(spark, path)
    kind = placed.schema["doc_id"].dataType.simpleString()
    digests = placed.select("file", "at", "doc_id", "ids", "n_tokens").mapInArrow(_crc32, f"file long, at long, doc_id {kind}, n_tokens long, ids_crc32 long")
    return _starts(placed, digests).select("doc_id", "start", "n_tokens", "ids_crc32")
