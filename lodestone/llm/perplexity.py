"""Quality rules with n-gram perplexity.

Texts are judged by grams of POINTS code points as they are, in any script; their number grows with the corpus.
Spark counts the grams of all texts by language, summed up within each task first; modified Kneser-Ney smoothing turns
the counts into probabilities, again as DataFrame work. The model is stored as arrays of hashes in ascending order with
the log-probabilities beside them. The distinct grams of a unit of texts are asked for as arrays of hashes, dealt by
range of hash, so that a task looks up what all units want of its range and reads each piece of the model about once;
the answers go back by unit to the tasks that score. No worker holds the model. Each language has a lower and an
upper band of log-perplexity a word, from the median and the median absolute deviation over its texts: marks that are
put to every word cost little each, as they are foreseen, but much a word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import scratch, slices, small_side, utf8, written

#: Code points of a gram; bytes of text whose grams a task gathers at once; bytes of the model that it reads at once.
POINTS, UNIT_BYTES, MODEL_BYTES = 5, 32 << 20, 8 << 20
#: Grams of the model in a range of hashes, the bits of which ranges are made at most, and tasks that share a range.
RANGE_GRAMS, RANGE_BITS, SHARED = 1 << 15, 12, 16
#: How far a band reaches below and above the median: so many median absolute deviations, and so many nats a word at least.
BELOW, ABOVE, LEAST_WIDTH = 5.0, 8.0, 0.4
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEATED = 50, 50


#: What the code points of a gram are multiplied by: powers of an odd number.
_WEIGHTS = [pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(POINTS)]


def points(texts: list[str], lang: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the grams of all texts, each begun by line ends; the place of each in the code points; these.

    A key mixes language and code points to 64 bits. U+0000 counts as U+0001.
    """
    pad = "\n" * (POINTS - 1)
    data = np.maximum(np.frombuffer("".join(pad + t for t in texts).encode("utf-32-le"), "<u4"), 1)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(sizes + len(pad)) - sizes - len(pad)
    keep = np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    n = len(data) - len(pad)
    wide = data.astype(np.uint64)
    return point_keys([wide[k : n + k] for k in range(POINTS)], lang)[keep], keep, data


def point_keys(codes: Sequence[np.ndarray], lang: str) -> np.ndarray:
    """codes: POINTS rows, a column for each gram."""
    with np.errstate(over="ignore"):
        x = np.full(len(codes[0]), zlib.crc32(lang.encode()) + 1, np.uint64)
        for row, weight in zip(codes, _WEIGHTS, strict=True):
            x += row.astype(np.uint64, copy=False) * np.uint64(weight)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x.view(np.int64)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Slices of the batches in lists of about UNIT_BYTES of text."""
    held, size = [], 0
    for batch in slices(batches):
        held.append(batch)
        size += batch.column("text").nbytes
        if size >= UNIT_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, list[int], list[str]]]:
    """Each language with the places and texts of its rows that have text."""
    texts, langs = utf8(batch.column("text")), batch.column("lang").to_pylist()
    for lang in sorted(set(langs)):
        mine = [i for i, (x, t) in enumerate(zip(langs, texts, strict=True)) if x == lang and t]
        if mine:
            yield lang, mine, [texts[i].decode(errors="replace") for i in mine]


def _point_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums up by language within each unit; lo and hi: hashes of two texts that have the gram, equal if only one has it."""
    for unit in _units(batches):
        parts: dict[str, list[tuple[np.ndarray, ...]]] = {}
        for batch in unit:
            for lang, _, texts in _by_lang(batch):
                key, keep, data = points(texts, lang)
                codes, unique = pd.factorize(key)
                hashes = np.repeat(np.fromiter((zlib.crc32(t.encode()) >> 1 for t in texts), np.int32, len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
                first, lo, hi = np.empty(len(unique), np.int64), np.empty(len(unique), np.int32), np.empty(len(unique), np.int32)
                first[codes], lo[codes], hi[codes[::-1]] = keep, hashes, hashes[::-1]
                parts.setdefault(lang, []).append((unique, np.bincount(codes), np.stack([data[first + k] for k in range(POINTS)], axis=1), np.minimum(lo, hi), np.maximum(lo, hi)))
        for lang, found in parts.items():
            codes, unique = pd.factorize(np.concatenate([x[0] for x in found]))
            n = np.bincount(codes, weights=np.concatenate([x[1] for x in found])).astype(np.int64)
            first = np.empty(len(unique), np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            lo, hi = np.full(len(unique), np.iinfo(np.int32).max), np.full(len(unique), -1)
            np.minimum.at(lo, codes, np.concatenate([x[3] for x in found]))
            np.maximum.at(hi, codes, np.concatenate([x[4] for x in found]))
            lo, hi = lo.astype(np.int32), hi.astype(np.int32)
            text = np.ascontiguousarray(np.concatenate([x[2] for x in found])[first]).view(f"<U{POINTS}").ravel()
            for at in range(0, len(text), 1 << 16):
                part = pa.array(text[at : at + (1 << 16)].tolist(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), part, *(pa.array(x[at : at + (1 << 16)]) for x in (n, lo, hi))], names=["lang", "gram", "n", "lo", "hi"])


def count_points(docs: DataFrame) -> DataFrame:
    """(lang, gram, n, lo, hi) of the grams of POINTS code points of all texts of docs (lang, text).

    lo and hi are the same if one text alone, or copies of it, has the gram.
    """
    parts = docs.select("lang", "text").mapInArrow(_point_counts, "lang string, gram string, n long, lo int, hi int")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _model_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, texts = batch.column("lang").to_numpy(zero_copy_only=False), np.array(batch.column("gram").to_pylist(), f"<U{POINTS}")
        logp = batch.column("logp").to_numpy()
        codes = texts.view("<u4").reshape(-1, POINTS).T
        for lang in set(langs):
            mine = langs == lang
            yield pa.RecordBatch.from_arrays([pa.array(point_keys(codes[:, mine], lang)), pa.array(logp[mine].astype(np.float32))], names=["key", "logp"])


class SortedArrays:
    """The stored model: pieces of ascending keys with their log-probabilities, found by their ends."""

    def __init__(self, path: str):
        self.store, root = pa.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        self.pieces: list[tuple[int | None, int | None, str, int]] = []
        for info in self.store.get_file_info(pa.fs.FileSelector(root)):
            if info.base_name.endswith(".parquet"):
                with self.store.open_input_file(info.path) as f:
                    groups = pq.ParquetFile(f).metadata
                for g in range(groups.num_row_groups):
                    ends = groups.row_group(g).column(0).statistics
                    self.pieces.append((ends.min, ends.max, info.path, g) if ends is not None and ends.has_min_max else (None, None, info.path, g))
        self.last: tuple[tuple[str, int], np.ndarray, np.ndarray] | None = None

    def _read(self, path: str, group: int) -> tuple[np.ndarray, np.ndarray]:
        """A piece; the last one is kept, as keys that are asked for next are often of the same."""
        if self.last is None or self.last[0] != (path, group):
            with self.store.open_input_file(path) as f:
                piece = pq.ParquetFile(f).read_row_group(group)
            self.last = (path, group), piece["key"].to_numpy(), piece["logp"].to_numpy()
        return self.last[1:]

    def find(self, want: np.ndarray) -> np.ndarray:
        """The log-probability of each key of want, in ascending order; pieces that hold none of them aren't read."""
        logs = np.full(len(want), np.nan, np.float32)
        for least, most, path, group in self.pieces if len(want) else ():
            low, high = (0, len(want)) if least is None else (np.searchsorted(want, least), np.searchsorted(want, most, "right"))
            if low < high:
                key, logp = self._read(path, group)
                at = np.minimum(np.searchsorted(key, want[low:high]), len(key) - 1)
                there = key[at] == want[low:high]
                logs[low:high][there] = logp[at[there]]
        return logs


def _keys_of(unit: list[pa.RecordBatch]) -> tuple[list[tuple[int, list[int], np.ndarray, np.ndarray, np.ndarray]], np.ndarray, int]:
    """(batch, places, lengths, codes, keys) of the texts of a unit by language, all its keys in ascending order, and a hash of these."""
    held = []
    for at, batch in enumerate(unit):
        for lang, mine, texts in _by_lang(batch):
            codes, unique = pd.factorize(points(texts, lang)[0])
            held.append((at, mine, np.fromiter(map(len, texts), np.int64, len(texts)), codes.astype(np.int32), unique))
    want = np.unique(np.concatenate([x[4] for x in held] or [np.empty(0, np.int64)]))
    return held, want, np.uint64(xxhash.xxh64_intdigest(want.tobytes())).view(np.int64).item()


def _asked(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a unit wants of each range of keys."""
        for unit in _units(batches):
            _, want, name = _keys_of(unit)
            of = want >> (63 - bits) >> 1
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1), len(want)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    yield pa.RecordBatch.from_arrays([pa.array([of[a]], pa.int64()), pa.array([name], pa.int64()), pa.array([want[a:b].tobytes()], pa.binary())], names=["range", "unit", "keys"])

    return run


def _answered(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            model = model or SortedArrays(path)
            for of, unit, keys in zip(*(batch.column(c).to_pylist() for c in ("range", "unit", "keys")), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([of], pa.int64()), pa.array([unit], pa.int64()), pa.array([model.find(np.frombuffer(keys, np.int64)).tobytes()], pa.binary())], names=["range", "unit", "logs"])

    return run


def answers(rows: DataFrame, model: str, n: int) -> str:
    """The folder of what each unit of rows (doc_id, lang, text) is to know of a stored model of n grams."""
    bits = min(RANGE_BITS, (-(-n // RANGE_GRAMS)).bit_length())
    asked = rows.mapInArrow(_asked(bits), "range long, unit long, keys binary").repartition("range", F.pmod("unit", F.lit(SHARED))).sortWithinPartitions("range")
    told = asked.mapInArrow(_answered(model), "range long, unit long, logs binary")
    path = scratch(rows.sparkSession, "answers")
    told.repartition("unit").sortWithinPartitions("unit", "range").write.partitionBy("unit").parquet(path)
    return path


def _told(path: str, unit: int, size: int) -> np.ndarray | None:
    """The answers of a unit in the order of its keys; None where they are not those of as many keys."""
    store, root = pa.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    parts: dict[int, bytes] = {}  # units of the same keys have the same answers
    at = pa.fs.FileSelector(f"{root}/unit={unit}", allow_not_found=True)
    for info in store.get_file_info(at):
        if info.base_name.endswith(".parquet"):
            with store.open_input_file(info.path) as f:
                rows = pq.ParquetFile(f).read(["range", "logs"])
            parts |= zip(rows["range"].to_pylist(), rows["logs"].to_pylist(), strict=True)
    logs = np.frombuffer(b"".join(parts[k] for k in sorted(parts)), np.float32)
    return logs if len(logs) == size else None


def _tail(gram: Column, n: int) -> Column:
    """The last n code points."""
    return F.substring(gram, -n, n) if n else F.lit("")


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(lang, size, gram, logp, others) of each seen gram of 1 to POINTS code points, as counts (lang, gram, n, lo, hi) give it.

    logp: log of the interpolated probability of the last code point after the others. Below the single ones stands
    an even share of the code points that the language has. others: logp, but of a gram that one text alone has, as
    if it were unseen. Grams that several texts have are counted with each text's own. Lower orders count the
    distinct code points that stand before a gram. Discounts are those of modified Kneser-Ney; where its counts of
    counts are missing, 1/2.
    """
    of_size = {POINTS: written(counts, "gram-counts")}
    for size in range(POINTS - 1, 0, -1):
        of_size[size] = of_size[size + 1].groupBy("lang", _tail(F.col("gram"), size).alias("gram")).agg(F.count("*").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    lower: DataFrame | None = None
    made: list[DataFrame] = []
    for size in range(1, POINTS + 1):
        grams = of_size[size]
        n = [F.sum(F.when(F.col("n") == k, 1).otherwise(0)).alias(f"n{k}") for k in range(1, 5)]
        sums = grams.groupBy("lang").agg(*n, F.count("*").alias("kinds"))
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

        def discount(k: int, y=y):
            d = F.when((F.col(f"n{k}") > 0) & (F.col("n1") > 0), k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")).otherwise(F.lit(0.5))
            return F.greatest(F.lit(0.1), F.least(F.lit(k - 0.05), d)).alias(f"d{k}")

        # A row for each language; broadcast once counted, so that no language's grams are dealt to one task.
        cuts = written(sums.select("lang", "kinds", *(discount(k) for k in (1, 2, 3))), f"discounts-{size}")
        rows = grams.join(small_side(cuts), "lang").withColumn("cut", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")))
        rows = rows.withColumn("context", F.substring("gram", 1, size - 1))
        contexts = rows.groupBy("lang", "context").agg(F.sum("n").alias("all"), F.sum("cut").alias("free"), F.min("lo").alias("context_lo"), F.max("hi").alias("context_hi"))
        rows = rows.join(contexts, ["lang", "context"])
        if lower is None:
            rows = rows.withColumn("p_tail", 1 / F.col("kinds")).withColumn("others_tail", F.col("p_tail"))
        else:
            rows = rows.withColumn("tail", _tail(F.col("gram"), size - 1))
            rows = rows.join(lower.select("lang", F.col("gram").alias("tail"), F.col("p").alias("p_tail"), F.col("others").alias("others_tail")), ["lang", "tail"])
        p = (F.col("n") - F.col("cut") + F.col("free") * F.col("p_tail")) / F.col("all")
        weight = F.when(F.col("context_lo") != F.col("context_hi"), F.col("free") / F.col("all")).otherwise(1.0)
        others = F.when(F.col("lo") != F.col("hi"), p).otherwise(weight * F.col("others_tail"))
        lower = written(rows.select("lang", "gram", p.alias("p"), others.alias("others")), f"order-{size}")
        made.append(lower.select("lang", F.lit(size).alias("size"), "gram", F.log("p").alias("logp"), F.log("others").alias("others")))
    return reduce(DataFrame.unionByName, made)


def basics(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    words = text.split()
    n = len(words)
    starts = bytes(range(128, 192))  # the bytes that continue a code point
    chars = len(b"".join(words).translate(None, starts))
    symbols = sum(map(text.count, map(bytes, zip(SYMBOLS))))
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\v\f")]
    repeated = 0
    if n > 2:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        k = len(number)
        two = ids[:-1] * k + ids[1:]
        if k >= 1 << 20:  # three of them would not fit into 63 bits
            two = pd.factorize(two)[0]
        back = pd.factorize(two[:-1] * k + ids[2:])[0]
        hit = np.zeros(n, bool)
        again = np.bincount(back)[back] > 1
        for j in range(3):
            hit[j : n - 2 + j] |= again
        repeated = int(hit.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _scores(model: str, told: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _units(batches):
            held, want, name = _keys_of(unit)
            logs = _told(told, name, len(want))
            if logs is None:  # the rows came in other units than those that were asked for
                logs = SortedArrays(model).find(want)
            sums = [np.full(batch.num_rows, np.nan) for batch in unit]
            for at, mine, sizes, codes, unique in held:
                each = logs[np.searchsorted(want, unique)][codes]
                sums[at][mine] = -np.add.reduceat(each, np.cumsum(sizes) - sizes, dtype=np.float64)
            for batch, total in zip(unit, sums, strict=True):
                numbers = np.array([basics(t) for t in utf8(batch.column("text"))], np.int64).reshape(-1, 5).T
                score = np.where(numbers[0] > 0, total / np.maximum(numbers[0], 1), np.nan)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), *map(pa.array, numbers), pa.array(score, from_pandas=True)], names=["doc_id", "lang", *_FIELDS, "log_perplexity"])

    return run


def quality_rules(docs: DataFrame) -> DataFrame:
    """The base measures of each row of docs, base_failed, log_perplexity and kept.

    A null text counts as empty: it has no word, so it fails the base rules. Rows without language are a language of
    their own. A text is kept if it passes the base rules and its log-perplexity a word lies within the bands of
    its language; texts without words have none. Repeated rows count and return as often as they stand there; an empty table returns no row.
    """
    path = scratch(docs.sparkSession, "kneser-ney")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), "text")
    model = kneser_ney(count_points(rows)).where(F.col("size") == POINTS)  # every gram of the texts is in it
    arrays = model.select("lang", "gram", F.col("others").alias("logp")).mapInArrow(_model_keys, "key long, logp float")
    arrays.repartitionByRange("key").sortWithinPartitions("key").write.option("parquet.block.size", MODEL_BYTES).parquet(path)
    told = answers(rows, path, docs.sparkSession.read.parquet(path).count())
    rows = written(rows.mapInArrow(_scores(path, told), f"doc_id {kind}, lang string, " + ", ".join(f"{f} long" for f in _FIELDS) + ", log_perplexity double"), "perplexity")
    rows = rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))
    middle = written(rows.groupBy("lang").agg(F.percentile_approx("log_perplexity", 0.5, 10000).alias("middle")), "middles")
    off = rows.join(small_side(middle), "lang").withColumn("off", F.abs(F.col("log_perplexity") - F.col("middle")))
    spread = off.groupBy("lang").agg(F.first("middle").alias("middle"), F.percentile_approx("off", 0.5, 10000).alias("spread"))
    reach = lambda times: F.greatest(F.lit(LEAST_WIDTH), times * F.col("spread"))
    bands = written(spread.select("lang", (F.col("middle") - reach(BELOW)).alias("low"), (F.col("middle") + reach(ABOVE)).alias("high")), "bands")
    kept = ~F.col("base_failed") & F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(False))
    return rows.join(small_side(bands), "lang", "left").select("doc_id", *_FIELDS, "base_failed", kept.alias("kept"), "log_perplexity")
