"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into bins. Shallow trees are boosted on one feature after the other, round by round, and add up
to one lookup table for each feature; the pairs whose joint bins explain most of what is left then get two-way
tables in the same manner. A text's score is the logistic of the sum of its bins' entries.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import slices, utf8

#: The model is fitted to at most so many labelled rows, those of the smallest hashes of their doc_id.
TRAIN_ROWS = 20_000
BINS, ROUNDS, RATE, LEAVES, PAIRS, PAIR_BINS, PAIR_ROUNDS = 24, 60, 0.15, 3, 6, 8, 30
SYMBOLS = b"#*$%&|<>"
FEATURES = (
    "log_words", "word_length", "long_words", "symbol_share", "upper_share", "digit_share", "mark_share", "stop_share", "other_share", "space_share",
    "distinct_words", "top_word", "same_next", "repeated_triples", "short_words", "pressed", "lines", "words_a_line", "repeated_lines", "ended_lines",
)
_DROP_ALL_BUT = {name: bytes(x for x in range(256) if x not in keep) for name, keep in {
    "symbol": set(SYMBOLS), "upper": set(range(65, 91)), "digit": set(range(48, 58)), "mark": set(b"!?=_~^@/\\"), "stop": set(b".,;:"), "other": set(range(128, 256)), "space": set(b" \t\n\r\v\f"),
}.items()}


def features(text: bytes) -> list[float]:
    """The values of FEATURES; an empty text has defined ones too."""
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    n, chars = max(len(words), 1), max(len(text), 1)
    share = {k: len(text.translate(None, drop)) / chars for k, drop in _DROP_ALL_BUT.items()}
    counts = Counter(words)
    triples = len(words) - 2
    distinct = len({*zip(words, words[1:], words[2:], strict=False)}) if triples > 0 else 0
    return [
        np.log1p(len(words)), (len(text) - share["space"] * chars) / n, sum(len(w) > 20 for w in words) / n, share["symbol"], share["upper"], share["digit"], share["mark"], share["stop"], share["other"], share["space"],
        len(counts) / n, max(counts.values(), default=0) / n, sum(map(bytes.__eq__, words, words[1:])) / n, 1 - distinct / triples if triples > 0 else 0.0, sum(len(w) <= 3 for w in words) / n,
        len(zlib.compress(text, 1)) / (chars + 12), np.log1p(len(lines)), n / max(len(lines), 1), 1 - len(set(lines)) / max(len(lines), 1), sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / max(len(lines), 1),
    ]


@dataclass
class AdditiveModel:
    """start + the sum of the tables' entries is the logit; pairs: (feature, feature, table over coarse bins)."""

    start: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)]) if len(self.cuts) else np.empty((0, len(x)), int)
        logit = np.full(len(x), self.start)
        for table, b in zip(self.tables, bins, strict=True):
            logit += table[b]
        for i, j, table in self.pairs:
            logit += table[self.coarse[i][bins[i]], self.coarse[j][bins[j]]]
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """The step of each bin: the bins are split, greedily, into runs that share one Newton step."""
    steps = lambda a, b: (g[a:b].sum() ** 2) / (h[a:b].sum() + 1.0)
    runs = [(0, len(g))]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    while len(runs) < leaves:
        best = (1e-9, None, 0)
        for a, b in runs:
            if b - a > 1:
                k = np.arange(a + 1, b)
                gain = (cg[k] - cg[a]) ** 2 / (ch[k] - ch[a] + 1.0) + (cg[b] - cg[k]) ** 2 / (ch[b] - ch[k] + 1.0) - steps(a, b)
                if gain.max() > best[0]:
                    best = (gain.max(), (a, b), k[gain.argmax()])
        if best[1] is None:
            break
        runs.remove(best[1])
        runs += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in runs:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Cyclic boosting of one-feature trees, then of two-feature trees on the pairs that gain most.

    Without rows the score is 1/2 throughout; with labels of one kind only it is close to that label.
    """
    rate = (y.sum() + 0.5) / (len(y) + 1)
    model = AdditiveModel(float(np.log(rate / (1 - rate))), [], [], [], [])
    if len(y) < 2 or len(set(y.tolist())) < 2:
        return model
    model.cuts = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)) for j in range(x.shape[1])]
    bins = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.cuts)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    logit = np.full(len(y), model.start)

    def slopes(of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return np.bincount(of, y - p, n), np.bincount(of, p * (1 - p), n)

    for _ in range(ROUNDS):
        for b, table in zip(bins, model.tables, strict=True):
            step = RATE * _tree(*slopes(b, len(table)), LEAVES)
            table += step
            logit += step[b]
    model.coarse = [np.arange(len(t)) * PAIR_BINS // len(t) for t in model.tables]
    rough = [c[b] for c, b in zip(model.coarse, bins, strict=True)]
    joint = lambda i, j: rough[i] * PAIR_BINS + rough[j]

    def gain(pair: tuple[int, int]) -> float:
        g, h = slopes(joint(*pair), PAIR_BINS**2)
        return float((g**2 / (h + 1.0)).sum())

    chosen = sorted(itertools.combinations(range(len(bins)), 2), key=gain, reverse=True)[:PAIRS]
    model.pairs = [(i, j, np.zeros((PAIR_BINS, PAIR_BINS))) for i, j in chosen]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in model.pairs:
            g, h = (s.reshape(PAIR_BINS, PAIR_BINS) for s in slopes(joint(i, j), PAIR_BINS**2))
            cut = _tree(g.sum(1), h.sum(1), 2)  # one split of the first feature, then one of the second on either side
            step = np.zeros_like(table)
            for side in (cut == cut[0], cut != cut[0]):
                if side.any():
                    step[side] = _tree(g[side].sum(0), h[side].sum(0), 2)
            table += RATE * step
            logit += RATE * step[rough[i], rough[j]]
    return model


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = utf8(batch.column("text"))
        x = np.array([features(t) for t in texts], dtype=float)
        ids = batch.column("doc_id").cast(pa.string())
        tags = pa.array([xxhash.xxh64_intdigest(t) >> 1 for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([ids, tags, batch.column("label"), *(pa.array(c) for c in x.T)], names=["doc_id", "tag", "label", *FEATURES])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> AdditiveModel:
    """Fits labels (doc_id, quality 0 or 1) to the texts of docs; at most `rows` labelled rows are looked at.

    Labels without doc_id or quality are left out; a doc_id with several labels counts by their mean, 1 from 1/2 on.
    A null text counts as empty. The bound holds for rows of docs as well: equal rows are taken once, and of a doc_id
    that many different texts have, those of the smallest hashes.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # bounded, so it may be broadcast
    found = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").mapInArrow(_measured, "doc_id string, tag long, label double, " + ", ".join(f"{f} double" for f in FEATURES))
    # Features in place of texts are what is sorted; each task keeps `rows` of them at most before they meet.
    kept = found.dropDuplicates(["doc_id", "tag"]).orderBy(F.xxhash64("doc_id"), "tag", "doc_id").limit(rows)
    data: pd.DataFrame = kept.drop("doc_id", "tag").toPandas()
    data = data.sort_values(["label", *FEATURES], ignore_index=True)  # the same model whatever order the rows came in
    return fit(data[list(FEATURES)].to_numpy(float).reshape(-1, len(FEATURES)), data["label"].to_numpy(float))


def _scores(model: AdditiveModel) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = utf8(batch.column("text"))
            score = model.score(np.array([features(t) for t in texts], dtype=float).reshape(len(texts), len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, "score"])

    return run


def scored(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """docs with score, the probability of label 1."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(_scores(model), f"{schema}, score double")


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs.

    Null and empty texts are scored like any other. A row without doc_id is held out by no rule: its held_out is
    false. Repeated rows give repeated results, an empty table none; columns but doc_id and text are not looked at.
    """
    model = train(docs, labels.where(~F.coalesce(held_out(), F.lit(True))))
    rows = scored(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose text scores 1/2 or more, with the columns of docs, one named score too.

    Null and empty texts are scored like any other, so they stay or go together, as repeated rows and equal texts do;
    doc_id is not looked at. Without any label all rows score 1/2 and stay. An empty table gives none.
    """
    model = train(docs, labels.where(~F.coalesce(held_out(), F.lit(True))))
    plain = docs.withColumnRenamed("score", "score before") if "score" in docs.columns else docs
    return scored(plain, model).where("score >= 0.5").drop("score").toDF(*docs.columns)
