"""Delta-maintained token totals by source, language and tokenizer version.

A batch brings signed rows: +1 adds a document's tokens, -1 takes them away; a revision is both. Spark sums the batch
to one delta for each key before anything is shuffled, and the next version of the totals is the last one plus
the delta. Each version lists the batches that are in it, so that a batch which comes again changes nothing.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.byte_bpe import Pieces, Splitter, read_ranks
from lodestone.llm.common import scratch, slices, utf8
from lodestone.llm.token_files import encoder_of

KEYS = ("source", "lang", "tokenizer")
_SUMS = ("n_docs", "n_tokens")
#: Versions that stay besides the last.
KEEP = 2


def inserts(docs: DataFrame, counters: dict[str, Column]) -> DataFrame:
    """+1 rows of docs for each tokenizer version; counters: version to a count over the columns of docs.

    Null texts have no tokens; null sources and languages are keys of their own.
    """
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("tokenizer"), F.coalesce(v, F.lit(0)).cast("long").alias("tokens")) for k, v in counters.items())))
    return docs.select("source", "lang", each.alias("c")).select("source", "lang", "c.tokenizer", "c.tokens", F.lit(1).alias("sign"))


def deletes(docs: DataFrame, counters: dict[str, Column]) -> DataFrame:
    return inserts(docs, counters).withColumn("sign", F.lit(-1))


def revisions(docs: DataFrame, before: dict[str, Column], after: dict[str, Column]) -> DataFrame:
    """Takes away the old counts and adds the new ones."""
    return deletes(docs, before).unionByName(inserts(docs, after))


@lru_cache(2)
def _piece_ids(path: str, pattern: str) -> Pieces:
    import tiktoken

    return Pieces(tiktoken.Encoding("rollup", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})._encode_single_piece)


def tokenizer_counts(docs: DataFrame, word_path: str, byte_path: str, pattern: str) -> DataFrame:
    """docs (doc_id, source, lang, digest, text) with word and byte in place of text: its numbers of ids by the tokenizers of op4 and op10.

    The ids are those of these operators; here pieces that a worker has not seen yet are encoded by the tiktoken
    library. Null and empty texts have 0 ids; rows without doc_id and repeated rows are counted like others, an empty table
    gives none.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder_of(word_path)
        split, ids = Splitter(pattern), _piece_ids(byte_path, pattern)
        for batch in slices(batches):
            texts = utf8(batch.column("text"))
            counts = [pa.array(words.counts(texts), pa.int64()), pa.array([sum(map(len, map(ids.__getitem__, split(t.decode())))) // 4 for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *counts], names=[*kept, "word", "byte"])

    kept = ("doc_id", "source", "lang", "digest")
    kinds = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept]
    return docs.select(*kept, "text").mapInArrow(run, ", ".join([*kinds, "word long", "byte long"]))


def delta(changes: DataFrame) -> DataFrame:
    """The change of each key's totals; null sources and languages are keys, repeated rows count each, no rows no keys."""
    return changes.groupBy(*KEYS).agg(F.sum(F.col("sign").cast("long")).alias("n_docs"), F.sum(F.col("sign") * F.col("tokens")).alias("n_tokens"))


class TokenRollup:
    """Totals as a row of versions under one folder.

    A writer writes a version to a folder of its own and commits it by the file v<number>.commit, which names that
    folder and which only one writer can make; another that was first is noticed, and the batch is added to its version
    instead. The file is written under another name first, so no reader sees it half written; one without content, as
    a writer that died could leave behind when commits were written in place, does not count and its number is passed
    over. The last KEEP versions stay. On object stores, whose renames are not exclusive, there may be one
    writer at a time only.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch(spark, "rollup")
        self.version, self.folder = self._last()

    def _fs(self, name: str = ""):
        """The file system, and the path of a name in the folder."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _last(self) -> tuple[int, str]:
        fs, at = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        numbers = sorted((int(n[1:-7]) for n in names if n.endswith(".commit") and n[1:-7].isdigit()), reverse=True)
        self.taken = max(numbers, default=-1)
        return next(((n, folder) for n in numbers if (folder := self._folder(n))), (-1, ""))

    def _folder(self, version: int) -> str:
        """The folder that a commit file names; nothing where the file is empty or gone."""
        fs, at = self._fs(f"v{version}.commit")
        if not fs.exists(at) or not fs.getFileStatus(at).getLen():
            return ""
        return self.spark.read.text(f"{self.path}/v{version}.commit").first()[0]

    def _claimed(self, version: int, folder: str) -> bool:
        """Makes the commit file; False if it is there already."""
        fs, at = self._fs(f"v{version}.commit")
        if fs.exists(at):
            return False
        _, own = self._fs(f"_{folder}.commit")
        out = fs.create(own, False)
        out.write(bytearray(folder.encode()))
        out.close()
        try:
            if fs.getScheme() == "file":  # a rename there replaces what has the name, a link doesn't
                os.link(own.toUri().getPath(), at.toUri().getPath())
                return True
            return not fs.exists(at) and fs.rename(own, at)
        except FileExistsError:
            return False
        finally:
            fs.delete(own, False)

    def _read(self, what: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.folder}/{what}")

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Adds a batch; False, and nothing done, if a batch of this name is in already: the name says what is in it."""
        while True:
            done = self.spark.createDataFrame([(batch_id,)], "batch string")
            new = delta(changes)
            if self.version >= 0:
                if self._read("batches").where(F.col("batch") == batch_id).take(1):
                    return False
                new = self._read("totals").unionByName(new).groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in _SUMS))
                done = self._read("batches").unionByName(done)
            number = max(self.version, self.taken) + 1
            folder = f"v{number}-{uuid.uuid4().hex}"
            new.write.parquet(f"{self.path}/{folder}/totals")
            done.coalesce(1).write.parquet(f"{self.path}/{folder}/batches")
            if self._claimed(number, folder):
                self.version, self.folder = number, folder
                self._forget(self.version - KEEP - 1)
                return True
            self.version, self.folder = self._last()

    def _forget(self, version: int) -> None:
        """Removes the version's folder; the commit file stays, so that its number isn't given again."""
        if version >= 0 and (folder := self._folder(version)):
            fs, at = self._fs(folder)
            fs.delete(at, True)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs and n_tokens of the keys with any document left."""
        if self.version < 0:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer string, n_docs long, n_tokens long")
        return self._read("totals").where("n_docs != 0 or n_tokens != 0")


def replay(rollup: TokenRollup, batches: list[tuple[str, DataFrame]]) -> DataFrame:
    """Commits the batches in order, some perhaps again, and gives the totals."""
    reduce(lambda _, b: rollup.commit(*b), batches, None)
    return rollup.totals()
