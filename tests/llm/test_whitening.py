"""Whitening against numpy over all rows, with odd rows among them."""

import math

import numpy as np
import pytest

from lodestone.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA)


def plain(rows, k=32):
    ids = [i for i, v in rows]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1000000 for c in v] for _, v in rows])
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    dev = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    return ids, n, dev, e, u, c @ u[:, :k] / np.sqrt(np.maximum(e[:k], 1e-300))


def compare(got, rows, k, d):
    ids, n, dev, e, _, w = plain(rows, k)
    k = min(k, d)
    assert len(got) == len(rows) * k
    mine = np.zeros((len(rows), k))
    at = {i: p for p, i in enumerate(ids)}
    for r in got:
        p, j = at[r.vec_id], r.component - 1
        assert r.n == n and r.deviation == dev[p] and r.identity_error < 1e-9
        assert abs(r.explained - e[j] / e.sum()) <= 1e-10 * r.explained
        mine[p, j] = r.whitened
    for j in range(k):
        assert min(np.abs(mine[:, j] - w[:, j]).max(), np.abs(mine[:, j] + w[:, j]).max()) < 1e-6


@pytest.mark.parametrize("d", [6, 64])
def test_against_numpy(spark, d):
    rng = np.random.default_rng(d)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(400, d)) * np.linspace(3, 1, d))]
    odd = [(900, None), (901, [1.0] * (d - 1) + [None]), (902, [float("nan")] + [0.0] * (d - 1)), (903, [float("inf")] * d), (904, [1.0] * (d + 1)), (905, [])]
    got = whitening.whitening(table(spark, rows + odd)).collect()
    compare(got, rows, 32, d)


def test_few_strong_directions_need_no_full_basis(spark, monkeypatch):
    """A spectrum that falls steeply converges in the block; a flat one is widened. Both give the components of numpy."""
    rng = np.random.default_rng(5)
    turn = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    widths, product = [], whitening._summed
    monkeypatch.setattr(whitening, "_summed", lambda rows, of, kind, columns: (widths.append(columns), product(rows, of, kind, columns))[1])
    for scales, widened in ((10.0 ** np.linspace(3, -4, 64), False), (np.linspace(30, 20, 64), True)):
        rows = [(i, [float(v) for v in r]) for i, r in enumerate((rng.normal(size=(500, 64)) * scales) @ turn)]
        widths.clear()
        model = whitening.fit(whitening.counted(table(spark, rows)), components=8, oversample=24)
        assert (65 in widths) == widened
        e = plain(rows)[3]
        assert np.allclose(model.variances, e[:8], rtol=1e-9) and abs(model.trace - e.sum()) < 1e-9 * e.sum()


def test_odd_tables(spark):
    assert whitening.whitening(table(spark, [])).count() == 0
    assert whitening.whitening(table(spark, [(1, None)])).count() == 0
    assert whitening.whitening(table(spark, [(1, [0.5, 0.25])] * 3)).count() == 0  # no variance
    assert whitening.whitening(table(spark, [(1, []), (2, [])])).count() == 0
    line = [(None, [float(i), 2.0 * i, 1.0]) for i in range(5)]
    got = whitening.whitening(table(spark, line + line[:1])).collect()
    assert {r.component for r in got} == {1} and len(got) == 6 and abs(got[0].explained - 1) < 1e-12
    assert abs(sum(r.whitened**2 for r in got) / 6 - 1) < 1e-9


def test_deviations_are_exact():
    x, n = np.array([[10**9, 5], [0, 7]]), 10**6
    s = np.array([3 * 10**14, 11])
    assert whitening.deviations(x[1:] * 0 + 3, 5, np.array([1, 2])) == [14**2 + 13**2]
    assert whitening.deviations(x, n, s) == [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
