"""Toxicity: a support vector machine on a subsequence string kernel with Nyström landmarks.

A word is a string of letters between two ends. The kernel counts the triples of letters that two words have in the
same order, near each other though not side by side: each letter that is skipped halves a triple's weight. So an insult
with letters put in or left out still shares most of its weight with the insult; other characters inside a word are
passed over, and letters that stand apart ("i d i o t") are read as one word.

Labels are of texts, and most sentences of a toxic text are harmless. The machine is trained on sentences, in rounds:
those of harmless texts that come nearest to toxic are labelled harmless, of a toxic text those that look most toxic
are labelled toxic, and the next round learns from these. A sentence counts by its most toxic word, a text by its three
most toxic ones, whose scores a logistic curve turns into a probability.

The landmarks span the space that the machine works in, so its weights fold into one weight for each triple.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from heapq import nlargest

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import slices, written

#: The model is fitted to at most so many labelled texts, those of the smallest hashes.
TRAIN_ROWS = 20_000
#: Landmarks that tell toxic from harmless, and landmarks of common harmless words; candidates for either.
TOXIC_LANDMARKS, PLAIN_LANDMARKS, CANDIDATES = 96, 64, 1500
#: Words at most that the first round learns from: the most telling ones, and others by hash.
TELLING, BACKGROUND = 3000, 5000
#: Rounds after the first, sentences of a text that one learns from, and words of a text that count.
ROUNDS, SENTENCES, TOP = 2, 3, 3
#: Longest step between two letters of a triple, the weight of a skipped letter, and letters of a piece of a longer word.
STEP, DECAY, PIECE = 3, 0.5, 16
#: Scores below the first count as that, scores above the second as that.
FLOOR, CEILING = -0.5, 4.0
#: Letters that are told apart, and words that a worker keeps in mind.
LETTERS, SEEN = 96, 500_000
#: Weight of a toxic word's garbled forms beside its own.
GARBLED = 1.0
#: Scores at which the curve of the highest word may bend.
BENDS = (0.75, 1.25)
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n")
_NO_LETTER = re.compile(r"[^\w\n]+|[\d_]+")
_APART = re.compile(r"(?<!\w)(?:[^\W\d_][\W_]{1,3}){2,}[^\W\d_](?!\w)")
_ALONE = {a + b for a in map(chr, range(97, 123)) for b in ["", *".,-_*"]}
_SHIFTS = [(a, b) for a in range(1, STEP + 1) for b in range(1, STEP + 1)]


def words_of(text: str) -> set[str]:
    """The distinct words of a text in lower case, as they stand, and letters that stand apart as one word."""
    low = text.lower()
    words = set(low.split())
    if len(words & _ALONE) >= 3:
        words |= {re.sub(r"[\W_]+", "", m) for m in _APART.findall(low)}
    return words


def pieces_of(word: str) -> list[str]:
    """The word between its ends; a word of more than PIECE letters in pieces that overlap by half."""
    marked = f"^{word}$"
    if len(marked) <= PIECE + 2:
        return [marked]
    return [marked[at : at + PIECE + 2] for at in range(0, len(marked) - PIECE // 2 - 2, PIECE // 2)]


@dataclass
class Alphabet:
    """Codes of characters: 1 and 2 for the ends of a word, 3 for any that is not known."""

    letters: str
    size: int = field(init=False)
    codes: np.ndarray = field(init=False)

    def __post_init__(self):
        self.size = len(self.letters) + 4
        self.codes = np.full(0x110000, 3, np.uint8)
        self.codes[[ord("^"), ord("$")]] = 1, 2
        self.codes[[ord(c) for c in self.letters]] = np.arange(4, self.size)

    def coded(self, pieces: list[str]) -> np.ndarray:
        """A row of codes for each piece, filled up with zeros."""
        flat = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out = np.zeros((len(pieces), PIECE + 2), np.uint8)
        out[np.arange(PIECE + 2) < sizes[:, None]] = self.codes[flat]
        return out

    def triples(self, codes: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
        """(weight, a triple for each row or -1 where the row has ended), for each place and pair of steps."""
        c = codes.astype(np.int32)
        for a, b in _SHIFTS:
            for i in range(c.shape[1] - a - b):
                last = c[:, i + a + b]
                yield DECAY ** (a + b - 2), np.where(last > 0, (c[:, i] * self.size + c[:, i + a]) * self.size + last, -1)

    @classmethod
    def of(cls, pieces: list[str]) -> Alphabet:
        return cls("".join(sorted({c for p in pieces for c in p} - set("^$"))[:LETTERS]))

    def vectors(self, pieces: list[str]) -> list[dict[int, float]]:
        """The weights of each piece's triples, brought to length 1."""
        if not pieces:
            return []
        codes = self.coded(pieces)
        norms, out = self.norms(codes), [{} for _ in pieces]
        for w, ids in self.triples(codes):
            for j in np.flatnonzero(ids >= 0).tolist():
                out[j][int(ids[j])] = out[j].get(int(ids[j]), 0.0) + w / norms[j]
        return out

    def norms(self, codes: np.ndarray) -> np.ndarray:
        """The lengths of the rows as vectors of triples; a triple that occurs again adds to its weight."""
        found = list(self.triples(codes))
        ids, weights = np.stack([x for _, x in found], axis=1), np.array([w for w, _ in found])
        order = np.argsort(ids, axis=1, kind="stable")
        ids, w = np.take_along_axis(ids, order, 1), np.where(np.take_along_axis(ids, order, 1) >= 0, weights[order], 0.0)
        sums = np.cumsum(w, axis=1)
        ends = np.ones(ids.shape, bool)
        ends[:, :-1] = ids[:, 1:] != ids[:, :-1]
        out = np.zeros(len(ids))
        rows, cols = np.nonzero(ends)
        value = sums[rows, cols]
        before = np.zeros_like(value)
        before[1:] = np.where(rows[1:] == rows[:-1], value[:-1], 0.0)
        np.add.at(out, rows, (value - before) ** 2)
        return np.sqrt(np.maximum(out, 1e-12))


def least_norms() -> np.ndarray:
    """By the number of codes in a row: its length if no triple occurs twice, which is the least it can have."""
    sizes = np.arange(PIECE + 3)
    squares = sum(np.maximum(sizes - a - b, 0) * DECAY ** (2 * (a + b - 2)) for a, b in _SHIFTS)
    return np.sqrt(np.maximum(squares, 1e-12))


def kernel(a: str, b: str) -> float:
    """The normalised kernel of two words between their ends, by its definition."""

    def vector(s: str) -> dict:
        out: dict = {}
        for i in range(len(s)):
            for j in range(i + 1, min(i + STEP, len(s) - 1) + 1):
                for k in range(j + 1, min(j + STEP, len(s) - 1) + 1):
                    out[s[i], s[j], s[k]] = out.get((s[i], s[j], s[k]), 0.0) + DECAY ** (k - i - 2)
        return out

    x, y = vector(a), vector(b)
    dot = lambda p, q: sum(w * q.get(t, 0.0) for t, w in p.items())
    return dot(x, y) / max(np.sqrt(dot(x, x) * dot(y, y)), 1e-12)


class Landmarks:
    """The kernel of any piece with each of some pieces, and the map of Nyström that they span."""

    def __init__(self, pieces: list[str]):
        self.alphabet = Alphabet.of(pieces)
        vectors = self.alphabet.vectors(pieces)
        known = sorted({t for v in vectors for t in v})
        self.index = np.zeros(self.alphabet.size**3 + 1, np.int32)  # the last is for triples beyond the end
        self.index[known] = np.arange(1, len(known) + 1)
        self.table = np.zeros((len(known) + 1, len(pieces)))
        for j, vector in enumerate(vectors):
            for t, w in vector.items():
                self.table[self.index[t], j] = w
        e, v = np.linalg.eigh(self.similar(pieces))
        kept = e > 1e-6 * max(e.max(initial=0), 1e-12)
        self.root = v[:, kept] / np.sqrt(e[kept])

    def similar(self, pieces: list[str]) -> np.ndarray:
        codes = self.alphabet.coded(pieces)
        out = np.zeros((len(pieces), self.table.shape[1]))
        for w, ids in self.alphabet.triples(codes):
            out += w * self.table[self.index[ids]]
        return out / self.alphabet.norms(codes)[:, None]

    def mapped(self, pieces: list[str]) -> np.ndarray:
        return self.similar(pieces) @ self.root

    def folded(self, weights: np.ndarray) -> np.ndarray:
        """The machine's weights as one for each triple, at its index."""
        return self.table @ (self.root @ weights)


@dataclass
class Machine:
    """The score of a piece is the sum of its triples' weights over its length, plus bias."""

    alphabet: Alphabet
    index: np.ndarray
    weights: np.ndarray
    bias: float

    def pieces(self, pieces: list[str]) -> np.ndarray:
        """Scores between FLOOR and CEILING; lengths are worked out only where the score may be over FLOOR."""
        codes = self.alphabet.coded(pieces)
        raw = np.zeros(len(pieces))
        for w, ids in self.alphabet.triples(codes):
            raw += w * self.weights[self.index[ids]]
        most = np.maximum(raw, 0) / least_norms()[(codes > 0).sum(axis=1)] + self.bias
        out = np.full(len(pieces), FLOOR)
        may = np.flatnonzero((most > FLOOR) | (self.bias > FLOOR))
        if len(may):
            out[may] = np.clip(raw[may] / self.alphabet.norms(codes[may]) + self.bias, FLOOR, CEILING)
        return out

    def words(self, words: list[str]) -> np.ndarray:
        """The scores of words as they stand in texts; each the largest of its pieces, FLOOR where it has no letter."""
        plain = _NO_LETTER.sub("", "\n".join(words)).split("\n") if words else []
        cut = [pieces_of(w) if w else [] for w in plain]
        out = np.full(len(words), FLOOR)
        for at in range(0, len(cut), 20_000):
            part = cut[at : at + 20_000]
            flat = [p for ps in part for p in ps]
            if flat:
                np.maximum.at(out, np.repeat(np.arange(at, at + len(part)), [len(ps) for ps in part]), self.pieces(flat))
        return out


class Reader:
    """Scores of the words of texts by one machine; keeps in mind what it has seen."""

    def __init__(self, machine: Machine):
        self.machine, self.seen, self.high = machine, set(), {}

    def learn(self, sets: list[set[str]]) -> None:
        if len(self.seen) > SEEN:
            self.seen, self.high = set(), {}
        new = list(set().union(*sets) - self.seen)
        scores = self.machine.words(new)
        self.seen.update(new)
        self.high.update((new[i], float(scores[i])) for i in np.flatnonzero(scores > FLOOR))

    def top(self, words: set[str], n: int = TOP) -> list[tuple[float, str]]:
        """The n highest (score, word), of words that were learned."""
        return nlargest(n, ((self.high[w], w) for w in words & self.high.keys()))


@dataclass
class Model:
    machine: Machine
    curve: np.ndarray  # bias and a weight for each of the measures

    def probability(self, tops: list[list[float]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(measures(tops) @ self.curve[1:] + self.curve[0], -40, 40)))


def measures(tops: list[list[float]]) -> np.ndarray:
    """What the curve is over: the TOP scores of each text, and by how much the highest is over each of BENDS."""
    x = np.array([[*t, *[FLOOR] * (TOP - len(t))] for t in tops]).reshape(-1, TOP)
    return np.column_stack([x, *(np.maximum(x[:, 0] - b, 0) for b in BENDS)])


def _texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [(x or b"").decode("utf-8", "replace") for x in batch.column(column).cast(pa.binary()).to_pylist()]


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 4.0) -> tuple[np.ndarray, float]:
    """Weights and bias of the least squared hinge loss plus half the squared weights; y: 1 or -1. By Newton's method."""
    x1 = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x1.shape[1]), np.append(np.ones(x.shape[1]), 1e-6)

    def loss(v: np.ndarray) -> float:
        return 0.5 * (ridge * v * v).sum() + c * (weight * np.maximum(1 - y * (x1 @ v), 0) ** 2).sum()

    now = loss(w)
    for _ in range(50):
        off = 1 - y * (x1 @ w)
        on = off > 0
        slope = ridge * w - 2 * c * (x1[on] * (weight * y * off)[on, None]).sum(axis=0)
        step = np.linalg.solve(np.diag(ridge) + 2 * c * (x1[on] * weight[on, None]).T @ x1[on], slope)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if now - (now := loss(w)) <= 1e-9 * max(now, 1):
            break
    return w[:-1], float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Bias and weights of a logistic curve, by Newton's method."""
    x1, w = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -40, 40)))
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + ridge * np.eye(len(w)), x1.T @ (p - y) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = []
        for label, text in zip(batch.column("label").to_pylist(), _texts(batch), strict=True):
            plain = _NO_LETTER.sub("", "\n".join(words_of(text))).split("\n")
            rows += [(label, p) for p in {p for w in plain if w for p in pieces_of(w)}]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string())], names=["label", "piece"])


def _witnesses(machine: Machine) -> Callable:
    """Of each text the words of its SENTENCES most toxic sentences, a word for each, with their scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(machine)
        for batch in slices(batches):
            texts = [[words_of(s) for s in _SENTENCE.split(t)] for t in _texts(batch)]
            reader.learn([w for sentences in texts for w in sentences])
            best = [nlargest(SENTENCES, {top[0] for s in sentences if (top := reader.top(s, 1))}) for sentences in texts]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([[w for _, w in b] for b in best], pa.list_(pa.string()))], names=["label", "words"])

    return run


def _tops(machine: Machine) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(machine)
        for batch in slices(batches):
            sets = [words_of(t) for t in _texts(batch)]
            reader.learn(sets)
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([[s for s, _ in reader.top(w)] for w in sets], pa.list_(pa.float64()))], names=["label", "tops"])

    return run


def telling(a: Column, b: Column, of_a: int, of_b: int) -> Column:
    """Twice the log likelihood ratio of a of of_a against b of of_b; negative where a is the rarer."""
    part = lambda n, all_: F.when(n > 0, n * F.ln(n * (of_a + of_b) / ((a + b) * all_))).otherwise(0.0)
    return 2 * (part(a, F.lit(of_a)) + part(b, F.lit(of_b))) * F.when(a * of_b >= b * of_a, 1).otherwise(-1)


def apart(candidates: list[str], n: int, chosen: list[str], most: float = 0.7) -> list[str]:
    """The first n candidates of which none is more than `most` like another or a chosen one."""
    alphabet = Alphabet.of([*chosen, *candidates])
    kept, out = alphabet.vectors(chosen), []
    for piece, vector in zip(candidates, alphabet.vectors(candidates), strict=True):
        if len(out) < n and all(sum(w * other.get(t, 0.0) for t, w in vector.items()) <= most for other in kept):
            kept.append(vector)
            out.append(piece)
    return out


def garbled(piece: str) -> list[str]:
    """The piece without each of its inner letters, and with a letter of its own put in at each inner place."""
    inner = range(2, len(piece) - 1)
    return [*(piece[:i] + piece[i + 1 :] for i in inner if len(piece) > 6), *(piece[:i] + piece[(5 * i) % (len(piece) - 2) + 1] + piece[i:] for i in inner if len(piece) < PIECE + 2)]


def _landmarks(pieces: DataFrame, toxic: int, plain: int) -> Landmarks:
    """Telling parts of words and common harmless words; pieces: (piece, a, b), the texts of either label that have it."""
    size = F.length("piece")
    parts = pieces.select("a", "b", F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(4), F.least(F.lit(8), size)), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.col("piece").substr(i, n)))))).alias("part")).where(size >= 4)
    sums = parts.groupBy("part").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    both = pieces.where(size >= 4).select(F.col("piece").alias("part"), "a", "b").where(size > 8).unionByName(sums)
    # Parts that tell as much are told apart by their text, so that the order is the same in each run.
    first = [r.part for r in both.where("a > 0").withColumn("by", telling(F.col("a"), F.col("b"), toxic, plain)).where("by > 0").orderBy(F.desc("by"), F.desc(F.length("part")), "part").limit(CANDIDATES).collect()]
    common = [r.piece for r in pieces.where(size >= 4).orderBy(F.desc("b"), "piece").limit(CANDIDATES // 3).collect()]
    chosen = apart(first, TOXIC_LANDMARKS, [])
    return Landmarks([*chosen, *apart(common, PLAIN_LANDMARKS, chosen)])


def train(labelled: DataFrame) -> Model:
    """Fits texts (label 0 or 1, text), of which there have to be few enough to fit a model to.

    Without both labels among them the score is the share of label 1, or 1/2 without any text.
    """
    counts = {r.label: r.n for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, plain = counts.get(1, 0), counts.get(0, 0)
    rate = (toxic + 0.5) / (toxic + plain + 1)
    if not toxic or not plain:
        return Model(Machine(Alphabet(""), np.zeros(4**3 + 1, np.int32), np.zeros(1), FLOOR - 1), np.array([np.log(rate / (1 - rate)), *[0.0] * (TOP + len(BENDS))]))
    found = labelled.mapInArrow(_words, "label int, piece string").groupBy("piece").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
    pieces = written(found, "toxic-pieces")
    marks = _landmarks(pieces, toxic, plain)
    by = telling(F.col("a"), F.col("b"), toxic, plain)
    most = [(r.piece, r.a, r.b) for r in pieces.where("a > 0").orderBy(F.desc(by), "piece").limit(TELLING).collect()]
    others = [(r.piece, r.a, r.b) for r in pieces.orderBy(F.xxhash64("piece"), "piece").limit(BACKGROUND).collect()]
    base = {p: (a, b) for p, a, b in [*others, *most]}
    machine = _fitted(marks, [(p, 1, a * plain / toxic) for p, (a, _) in base.items() if a] + [(p, -1, b) for p, (_, b) in base.items() if b])
    ground = [(p, -1, 1.0) for p, _, b in others if b]
    for _ in range(ROUNDS):
        seen = labelled.mapInArrow(_witnesses(machine), "label int, words array<string>").select("label", F.explode("words").alias("word"))
        rows = [(r.word, r.label, r.n) for r in seen.groupBy("label", "word").agg(F.count("*").alias("n")).orderBy("label", "word").collect()]
        scores = machine.words([w for w, _, _ in rows])
        share = plain / toxic
        next_ = list(ground)
        for (word, label, n), score in zip(rows, scores.tolist(), strict=True):
            if not label or score > 0:
                clean = _NO_LETTER.sub("", word)
                cut = pieces_of(clean)
                best, weight = cut[int(np.argmax(machine.pieces(cut)))], n * share**0.5 if label else float(n)
                next_.append((best, 1 if label else -1, weight))
                next_ += [(v, 1, GARBLED * weight / len(best)) for v in garbled(best)] if label else []
        if any(y > 0 for _, y, _ in next_):
            machine = _fitted(marks, next_)
    tops = labelled.mapInArrow(_tops(machine), "label int, tops array<double>").collect()
    tops.sort(key=lambda r: (r.label, r.tops))
    return Model(machine, logistic(measures([r.tops for r in tops]), np.array([float(r.label) for r in tops])))


def _fitted(marks: Landmarks, rows: list[tuple[str, int, float]]) -> Machine:
    rows = sorted(rows)
    weight = np.array([w for _, _, w in rows], float)
    w, bias = svm(marks.mapped([p for p, _, _ in rows]), np.array([y for _, y, _ in rows], float), weight / weight.mean())
    return Machine(marks.alphabet, marks.index, marks.folded(w), bias)


def labelled_texts(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """label and text of at most `rows` rows of docs with a label (doc_id, toxic), by the smallest hashes.

    Labels without doc_id or toxic are left out; a doc_id with several labels counts by their mean, 1 from 1/2 on. The
    bound holds for rows of docs, however often a doc_id is repeated there.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("label"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # bounded, so it may be broadcast
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")
    kept = texts.orderBy(F.xxhash64("doc_id"), F.xxhash64("text"), "doc_id").limit(rows).select("label", "text")
    return kept.repartition(4 * docs.sparkSession.sparkContext.defaultParallelism)


def _scores(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.machine)
        for batch in slices(batches):
            sets = [words_of(t) for t in _texts(batch)]
            reader.learn(sets)
            score = model.probability([[s for s, _ in reader.top(w)] for w in sets])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return run


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score, the probability of label 1, of each row of docs."""
    return docs.select("doc_id", "text").mapInArrow(_scores(model), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def toxic_sentences(docs: DataFrame, model: Model, least: float = 0.0) -> DataFrame:
    """doc_id, start, sentence, word and score of each sentence whose most toxic word scores over `least` (0: on the
    toxic side of the machine); start counts characters of the text from 0. FLOOR is the least that can be asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.machine)
        for batch in slices(batches):
            rows = []
            for id_, text in zip(batch.column("doc_id").to_pylist(), _texts(batch), strict=True):
                starts = [0, *(m.end() for m in _SENTENCE.finditer(text))]
                ends = [*(m.start() for m in _SENTENCE.finditer(text)), len(text)]
                sentences = [text[a:b] for a, b in zip(starts, ends, strict=True)]
                sets = [words_of(s) for s in sentences]
                reader.learn(sets)
                for start, sentence, words in zip(starts, sentences, sets, strict=True):
                    if (top := reader.top(words, 1)) and top[0][0] > least:
                        rows.append((id_, start, sentence, top[0][1], top[0][0]))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (batch.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "start", "sentence", "word", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, sentence string, word string, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs.

    Null and empty texts are scored like any other, as texts without a toxic word. A row without doc_id is held out by
    no rule: its held_out is false. Bytes that are no UTF-8 are read as replacement characters. Repeated rows give
    repeated results, an empty table none; columns but doc_id and text are not looked at.
    """
    model = train(written(labelled_texts(docs, labels.where(~F.coalesce(held_out(), F.lit(True)))), "toxic-texts"))
    rows = scored(docs, model)
    return rows.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
