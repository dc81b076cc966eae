"""Spelling variants: words one edit apart, met by a rare-first prefix filter on positional bigrams.

Bigrams are ordered by how many places of the vocabulary hold them, rarest first. One edit touches two bigrams of a
word at most, so of a word's three rarest one is left whole, and the same bigram is among the three rarest of the
near word, or of the other of the two whose third is the more frequent. (Further places of the third's bigram count as
well: else words that repeat a bigram could miss each other.) The bigram's place limits what can meet: the edit is on
one side of it, so the whole other side is equal, counted from that end of the word. Of the side with the edit one
half is equal too, which is the rest of the key; what meets is verified.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import UPPER, slices, written

#: Least code points and occurrences of a word.
MIN_LENGTH, MIN_COUNT = 5, 3
#: A form occurs at least so many times as often as the word.
FORM_TIMES = 2
#: Rarest bigrams of a word that are joined: one more than an edit touches.
RAREST = 3
#: Distinct words that a task counts before it hands them on.
HELD = 300_000
_LETTERS = bytes(x + 32 if chr(x) in UPPER else x if 97 <= x <= 122 or x >= 0xC0 else 32 for x in range(256))


def runs(text: str) -> list[bytes]:
    """The maximal runs of A-Z, a-z and U+00C0 to U+00FF, in Latin-1, A-Z in lower case."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def misspelt(run: bytes, code: int) -> bytes:
    """The run without the code point that code points at."""
    at = code % len(run)
    return run[:at] + run[at + 1 :]


def _counted(drop: int | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            words = [w.decode("latin-1") for w in counts]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

        for batch in slices(batches):
            ids = batch.column("doc_id").to_pylist()
            for id_, text in zip(ids, pc.fill_null(batch.column("text"), "").to_pylist(), strict=True):
                own = Counter(runs(text))
                if drop and id_ is not None:
                    start = zlib.crc32(f"{id_}:".encode())
                    codes = [(w, zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)) for w in own]
                    moved = [(misspelt(w, code), own.pop(w)) for w, code in codes if code % drop == 0]
                    for w, n in moved:
                        own[w] += n
                counts.update(own)
                if len(counts) > HELD:
                    yield out()
                    counts.clear()
        yield out()

    return run


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, drop: int | None = None) -> DataFrame:
    """word and n of each word of so many code points and occurrences.

    With `drop`, a run loses a code point wherever `drop` divides the CRC-32 of "<doc_id>:<run>" (the code point at the
    CRC modulo the length); rows without doc_id keep theirs. Each task counts its own words before they are shuffled.
    """
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    found = rows.mapInArrow(_counted(drop), "word string, n long").where(F.length("word") >= min_length)
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def keys_of(word: str, rank: dict[str, int]) -> set[tuple]:
    """(side, equal side, least length of the other, half, that half) of what words one edit away share with this one."""
    grams = [(rank[word[p : p + 2]], p) for p in range(len(word) - 1)]
    third = sorted(grams)[:RAREST][-1][0]
    keys = set()
    for r, p in grams:
        if r <= third:
            for side, same, rest in ((0, word[: p + 2], word[p + 2 :]), (1, word[p:], word[:p])):
                for m in (len(rest), len(rest) - 1):  # this one is the shorter, or the longer of the two
                    if m >= 0:
                        half = m // 2
                        keys |= {(side, same, m, 0, rest[:half]), (side, same, m, 1, rest[len(rest) - (m - half) :])}
    return keys


def _keyed(rank: dict[str, int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, keys, short = [], [], []
            for word in batch.column("word").to_pylist():
                for key in keys_of(word, rank):
                    side, same, m, half, part = key
                    words.append(word)
                    keys.append(f"{side}{half}{m}/{same}/{part}")
                    short.append(m == len(word) - len(same))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(short, pa.bool_()), pa.array(words, pa.string())], names=["key", "short", "word"])

    return run


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs (a, b) of words that differ by exactly one inserted, deleted or replaced code point, each pair both ways.

    words: distinct, of four code points or more each. A word that no other is near is in no pair.
    """
    grams = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda p: F.col("word").substr(p, F.lit(2)))).alias("gram"))
    # Pairs of letters, so their number doesn't grow with the words.
    order = [r.gram for r in grams.groupBy("gram").count().orderBy("count", "gram").collect()]
    keyed = written(words.select("word").mapInArrow(_keyed({g: i for i, g in enumerate(order)}), "key string, short boolean, word string").select(F.xxhash64("key").alias("key"), "short", "word"), "spelling-keys")
    a, b = keyed.where("short").select("key", F.col("word").alias("a")), keyed.select("key", "short", F.col("word").alias("b"))
    # Keys only bring together what may be near; equal hashes of different keys are sorted out here as well.
    met = a.join(b, "key").where("(not short or a < b) and levenshtein(a, b, 1) = 1").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    met = written(met, "spelling-pairs")
    return met.unionByName(met.select(F.col("b").alias("a"), F.col("a").alias("b")))


def roots(forms: DataFrame) -> DataFrame:
    """word and root of each row (word, form): the form of the form, and so on to the last.

    Forms occur at least twice as often as their words, so no chain is longer than the logarithm of the largest count,
    and each round doubles the steps that are taken.
    """
    now = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if not now.join(on, "root", "left_semi").limit(1).count():
            return now
        now = written(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")


def variants(counts: DataFrame, times: int = FORM_TIMES) -> DataFrame:
    """word, n, n_near, form, form_n and root of each row of counts (word, n).

    The form of a word is its near word of the largest n (ties: the smallest in code-point order), if that is at least
    `times` the word's own n; words without a form are their own root. An empty table gives no row.
    """
    counts = written(counts.select("word", "n"), "spelling-words")
    of = near_pairs(counts.select("word")).join(counts.select(F.col("word").alias("b"), F.col("n").alias("m")), "b")
    best = of.groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "b")).alias("best"))
    rows = written(counts.join(best, counts["word"] == best["a"], "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.less") >= times * F.col("n"), F.col("best")).alias("best")
    ), "spelling-forms").select("word", "n", "n_near", F.col("best.b").alias("form"), (-F.col("best.less")).alias("form_n"))
    last = roots(rows.where("form is not null"))
    return rows.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, drop: int | None = None) -> DataFrame:
    """word, n, n_near, form, form_n and root of the words of all texts of docs.

    Null and empty texts have no words, repeated rows count again, and columns but doc_id and text are not looked at.
    An empty table gives no row.
    """
    return variants(word_counts(docs, drop=drop))
