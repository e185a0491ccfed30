"""Whitening against plain whole-number and numpy arithmetic."""

import math
import random

import numpy as np
import pytest

from commlens.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x string, part string, index string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "p", "i") for i, v in rows], SCHEMA)


def vectors(n, dim, seed=1):
    rng = random.Random(seed)
    shapes = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(dim)]
    out = []
    for i in range(n):
        w = [rng.gauss(0, 1) / (k + 1) for k in range(dim)]
        out.append((i, [float(np.float32(sum(a * s[d] for a, s in zip(w, shapes, strict=True)))) for d in range(dim)]))
    return out


def plain(rows, components):
    xs = [
        (i, tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v))
        for i, v in rows
        if v and all(c is not None and math.isfinite(c) for c in v)
    ]
    fit = sorted({x for _, x in xs})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums, strict=True)] for x in fit])
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    return xs, n, sums, values[::-1][:components], vecs[:, ::-1][:, :components], values.sum()


def test_whitened_rows(spark):
    rows = vectors(400, 20)
    rows += [(1000 + i, rows[0][1]) for i in range(150)] + [(3, rows[3][1]), (None, rows[4][1])]
    rows += [(2000, None), (2001, [1.0] * 19 + [float("nan")]), (2002, [float("inf")] * 20), (2003, [None] + [1.0] * 19), (2004, [])]
    xs, n, sums, values, vecs, trace = plain(rows, 16)
    got = whitening.whitened(frame(spark, rows).repartition(5)).collect()
    assert len(got) == 16 * len(xs) and {r["n"] for r in got} == {n}
    expected = {}
    for i, x in xs:
        y = np.array([(n * c - s) / n for c, s in zip(x, sums, strict=True)])
        expected.setdefault(i, []).append((sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)), y @ vecs / np.sqrt(values)))
    signs = {}
    for r in got:
        candidates = expected[r["vec_id"]]
        assert r["deviation"] in [d for d, _ in candidates]
        k = r["component"] - 1
        assert math.isclose(r["explained"], values[k] / trace, rel_tol=1e-9)
        assert r["identity_error"] < 1e-9
        value = next(w[k] for d, w in candidates if d == r["deviation"])
        assert math.isclose(abs(r["whitened"]), abs(value), rel_tol=1e-6, abs_tol=1e-7)
        if abs(value) > 1e-3:
            signs.setdefault(k, set()).add(np.sign(r["whitened"] * value))
    assert all(len(s) == 1 for s in signs.values()) and len(signs) == 16


def test_scatter_is_split_over_tasks(spark, monkeypatch):
    rows = vectors(300, 4, seed=2)
    whole = sorted(whitening.whitened(frame(spark, rows)).collect())
    monkeypatch.setattr(whitening, "BLOCK_CELLS", 40)
    monkeypatch.setattr(whitening, "BLOCKS_A_TASK", 3)
    split = sorted(whitening.whitened(frame(spark, rows)).collect())
    for a, b in zip(whole, split, strict=True):
        assert a["vec_id"] == b["vec_id"] and math.isclose(a["whitened"], b["whitened"], rel_tol=1e-9, abs_tol=1e-9)


def test_flat_directions_and_few_rows(spark):
    rows = [(i, [float(i), 2.0 * i, 5.0]) for i in range(6)]
    assert {r["component"] for r in whitening.whitened(frame(spark, rows)).collect()} == {1}
    assert whitening.whitened(frame(spark, rows[:1] * 3)).collect() == []
    assert whitening.whitened(frame(spark, [(1, None)])).collect() == []
    assert whitening.whitened(frame(spark, [])).collect() == []


def test_vectors_of_different_lengths(spark):
    with pytest.raises(Exception, match="different lengths"):
        whitening.whitened(frame(spark, [(1, [1.0]), (2, [1.0, 2.0])])).collect()
