"""Whitening of embeddings by a randomised range finder and Rayleigh-Ritz.

A random block of vectors, a few more than the components asked for, is multiplied by the covariance again and again,
each time over all centred rows, and brought back to an orthonormal basis. The covariance seen in that basis is solved
exactly. Where the residuals of what comes out are not down to rounding after some passes, the basis is widened to all
dimensions, in which one pass is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components, vectors of the block beyond them, and passes before the basis is widened.
COMPONENTS, OVERSAMPLE, PASSES = 32, 10, 3
#: Entries are counted in 64ths, from so far below zero.
SCALE, OFFSET = 64, 1_000_000
#: Residuals in parts of the largest eigenvalue, and variances that count as none in parts of the trace.
RESIDUAL, NONE = 1e-13, 1e-12
#: Rows that a task multiplies at once, and entries of a matrix in a row of the table that adds them up.
ROWS, WIDTH = 8192, 64


@dataclass
class Whitener:
    """n vectors with sums per dimension; components are the columns of `vectors`, by falling variance."""

    n: int
    sums: np.ndarray
    variances: np.ndarray
    vectors: np.ndarray
    trace: float

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (x - self.sums / self.n) @ self.vectors / np.sqrt(self.variances)


def usable(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """The rows whose vector is not null and holds no null, NaN or infinity."""
    # NaN is the largest double to Spark, so one comparison refuses it and infinity.
    return embeddings.where(F.col(column).isNotNull() & F.coalesce(F.forall(column, lambda c: F.abs(c.cast("double")) < float("inf")), F.lit(False)))


def counted(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """The usable rows with x, the entries as longs: floor(64 c) + 1,000,000."""
    return usable(embeddings, column).withColumn("x", F.transform(column, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + OFFSET))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column("x")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _summed(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray], kind: str, columns: int) -> np.ndarray:
    """The sum over all rows of the matrices that `of` makes of blocks of them; Spark adds them up, WIDTH entries a row."""
    width = min(columns, WIDTH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in _cut(batches):
            if batch.num_rows:
                part = of(_matrix(batch))
                total = part if total is None else total + part
        if total is not None:
            lines = np.pad(total, ((0, 0), (0, -columns % width))).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(lines)), pa.int32()), *(pa.array(c) for c in lines.T)], names=["i", *(f"c{j}" for j in range(width))])

    parts = rows.select("x").mapInArrow(run, ", ".join(["i int", *(f"c{j} {kind}" for j in range(width))]))
    sums = parts.groupBy("i").agg(*(F.sum(f"c{j}").alias(f"c{j}") for j in range(width))).orderBy("i").collect()
    return np.array([r[1:] for r in sums]).reshape(-1, columns + -columns % width)[:, :columns]


def fit(rows: DataFrame, components: int = COMPONENTS, oversample: int = OVERSAMPLE, passes: int = PASSES, seed: int = 13) -> Whitener | None:
    """The whitener of rows with x, vectors of one length; None without rows or without entries.

    Components of no variance (up to rounding) are left out, so there may be fewer than asked for. What is brought to
    the driver has a row for each dimension and a column for each vector of the block, whatever the number of rows.
    """
    both = _summed(rows, lambda x: np.column_stack([x.sum(axis=0, dtype=np.int64), np.full(x.shape[1], len(x))]), "long", 2)
    if not len(both):
        return None
    sums, n, d = both[:, 0], int(both[0, 1]), len(both)
    mean = sums / n

    def product(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The covariance times q, and its diagonal."""

        def of(x: np.ndarray) -> np.ndarray:
            c = x - mean
            return np.column_stack([c.T @ (c @ q), (c * c).sum(axis=0)])

        both = _summed(rows, of, "double", q.shape[1] + 1) / n
        return both[:, :-1], both[:, -1]

    width = min(d, components + oversample)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0] if width < d else np.eye(d)
    for at in range(passes + 1):
        if at == passes:
            q = np.eye(d)
        vq, diagonal = product(q)
        small = q.T @ vq
        e, u = np.linalg.eigh((small + small.T) / 2)
        e, u = e[::-1][:components], u[:, ::-1][:, :components]
        if q.shape[1] == d or (np.abs(vq @ u - q @ u * e).max() <= RESIDUAL * max(e[0], 1e-300)):
            break
        q = np.linalg.qr(vq)[0]
    trace = float(diagonal.sum())
    kept = e > NONE * max(trace, 1e-300)
    return Whitener(n, sums, e[kept], (q @ u)[:, kept], trace)


def identity_error(rows: DataFrame, model: Whitener) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity; 0 without components."""
    k = len(model.variances)
    if not k:
        return 0.0
    first = _summed(rows, lambda x: model.whiten(x).sum(axis=0)[:, None], "double", 1)[:, 0] / model.n

    def of(x: np.ndarray) -> np.ndarray:
        w = model.whiten(x) - first
        return w.T @ w

    return float(np.abs(_summed(rows, of, "double", k) / model.n - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """The sum over dimensions of (n x - S)^2 of each row, exactly."""
    y = n * x - sums
    top = max(int(np.abs(y).max()), 1) if y.size else 1
    if top * top * y.shape[1] < 1 << 63:
        return (y * y).sum(axis=1).tolist()
    return [sum(v * v for v in row) for row in y.tolist()]


def whitened(rows: DataFrame, model: Whitener) -> DataFrame:
    """vec_id, component, deviation, whitened and explained of each row and component."""
    k, explained = len(model.variances), model.variances / model.trace if model.trace else model.variances

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut(batches):
            if batch.num_rows:
                x, at = _matrix(batch), np.repeat(np.arange(batch.num_rows), k)
                yield pa.RecordBatch.from_arrays([
                    batch.column("vec_id").take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pc.take(pa.array(deviations(x, model.n, model.sums), pa.int64()), pa.array(at)),
                    pa.array(model.whiten(x).ravel()), pa.array(np.tile(explained, len(x))),
                ], names=["vec_id", "component", "deviation", "whitened", "explained"])

    return rows.select("vec_id", "x").mapInArrow(run, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, deviation long, whitened double, explained double")


def whitening(embeddings: DataFrame) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of each usable row and component.

    Rows whose vector is null or holds a null, NaN or infinity are left out, and so are rows whose vector has another
    length than most (ties: the greater length), which have no place in a covariance. Repeated rows count again and
    give repeated results; a null vec_id stays null; other columns are not looked at. Equal variances leave the choice
    of components open. Without rows, entries or variance there is no result row. A deviation beyond a long is an error.
    """
    rows = counted(embeddings.select("vec_id", "embedding"))
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if sizes:
        rows = rows.where(F.size("x") == sizes[0]["d"])
    model = fit(rows) if sizes else None
    if model is None or not len(model.variances):
        out = embeddings.select("vec_id").limit(0).selectExpr("vec_id", "0 as component", "0L as deviation", "0D as whitened", "0D as explained")
        n, off = 0, 0.0
    else:
        out, n, off = whitened(rows, model), model.n, identity_error(rows, model)
    return out.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(off).alias("identity_error"))
