"""Whitening against numpy's eigenvectors on small tables, with rows that fall out and vectors without variance."""

import math
import random

import numpy as np
import pytest

from skein.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, component int, y string, dim int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 7, "y", 3) for i, v in rows], SCHEMA)


def brute(rows, most):
    whole = [(i, v) for i, v in rows if v and all(e is not None and math.isfinite(e) for e in v)]
    dims = {}
    for v in {tuple(v) for _, v in whole}:
        dims[len(v)] = dims.get(len(v), 0) + 1
    dim = max(dims, key=lambda d: (dims[d], d))
    xs = [(i, tuple(math.floor(64 * float(np.float32(e))) + 1000000 for e in v)) for i, v in whole if len(v) == dim]
    fit = sorted({x for _, x in xs})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    a = np.array([[(n * e - s) / n for e, s in zip(x, sums)] for x in fit])
    e, vec = np.linalg.eigh(a.T @ a / n)
    e, vec = e[::-1], vec[:, ::-1].T
    out = [(i, n, sum((n * q - s) ** 2 for q, s in zip(x, sums)), np.array([(n * q - s) / n for q, s in zip(x, sums)]) @ vec[:most].T) for i, x in xs]
    return out, e, vec


def made(rng, n, dim, spread=1.0):
    turn = np.linalg.qr(rng.normal(size=(dim, dim)))[0] * np.linspace(3, 0.5, dim)
    return [[float(np.float32(x)) for x in row] for row in rng.normal(size=(n, dim)) @ turn * spread]


def test_against_eigenvectors(spark):
    rng = np.random.default_rng(3)
    vectors = made(rng, 300, 21)
    rows = [(k, v) for k, v in enumerate(vectors)] + [(k % 7, vectors[0]) for k in range(200)]
    rows += [(900, None), (901, []), (902, [None] + vectors[0][1:]), (903, [float("nan")] + vectors[0][1:]), (904, [float("inf")] + vectors[0][1:]), (905, [1.0, 2.0]), (None, vectors[5])]
    random.Random(1).shuffle(rows)
    got = whitening.whitened_components(table(spark, rows).repartition(11)).collect()
    want, e, _ = brute(rows, 16)
    assert len(got) == 16 * len(want) and {r["n"] for r in got} == {want[0][1]}
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-10
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {}).setdefault(r["component"], set()).add((r["deviation"], r["whitened"]))
        assert r["explained"] == pytest.approx(e[r["component"] - 1] / e.sum(), rel=1e-10)
    sign = {}
    for i, _, dev, w in want:
        for c in range(16):
            found = [x for d, x in by[i][c + 1] if d == dev]
            value = w[c] / math.sqrt(e[c])
            if abs(value) > 0.1 and c not in sign and len(found) == 1:
                sign[c] = math.copysign(1, found[0] * value)
    for i, _, dev, w in want:
        for c in range(16):
            assert min(abs(x * sign[c] - w[c] / math.sqrt(e[c])) for d, x in by[i][c + 1] if d == dev) < 1e-8


def test_small_deviations_keep_their_digits():
    rng = np.random.default_rng(5)
    q1, q2 = (np.linalg.qr(rng.normal(size=(40, 40)))[0] for _ in range(2))
    true = 10.0 ** -np.linspace(0, 9, 40)
    length, components = whitening.rotated(np.linalg.qr(q1 * true @ q2.T, mode="r"))
    assert np.allclose(length, true, rtol=1e-5)
    assert np.allclose(length[:20], true[:20], rtol=1e-9)
    assert np.abs(components @ components.T - np.eye(40)).max() < 1e-13
    odd, _ = whitening.rotated(rng.normal(size=(3, 1)))  # one column
    assert len(odd) == 1


def test_tree_of_triangles_is_one_qr(spark):
    rng = np.random.default_rng(8)
    rows = [(k, v) for k, v in enumerate(made(rng, 400, 6))]
    fit = whitening.integer_vectors(table(spark, rows)).select("y").repartition(70)  # three levels
    y = np.array([[math.floor(64 * e) for e in v] for _, v in rows])
    r = whitening.triangle(fit, len(rows), y.sum(0).tolist())
    a = y - y.mean(0)
    assert np.allclose(r.T @ r, a.T @ a, rtol=1e-10)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, []), (2, [float("nan")])]])
def test_nothing_whole(spark, rows):
    assert whitening.whitened_components(table(spark, rows)).collect() == []


def test_no_variance_and_huge_entries(spark):
    got = whitening.whitened_components(table(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])])).collect()
    assert len(got) == 4 and all(r["whitened"] is None and r["deviation"] == 0 and r["explained"] == 0 and r["identity_error"] is None and r["n"] == 1 for r in got)
    got = whitening.whitened_components(table(spark, [(1, [0.5, 1.0]), (2, [0.5, 3.0]), (3, [0.5, 2.0])])).collect()  # one component varies
    assert {(r["component"], r["whitened"] is None) for r in got} == {(1, False), (2, True)}
    got = whitening.whitened_components(table(spark, [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [1.0, 2.0])])).collect()
    assert len(got) == 6 and any(r["deviation"] is None for r in got) and all(r["n"] == 3 for r in got)


def test_integers_of_all_widths():
    y = np.array([[1, -128], [127, 128], [-129, 0], [2**15, 1], [2**40, -(2**62)], [-(2**31), 0]], np.int64)
    packed = whitening._packed(y)
    assert [len(p) for p in packed] == [2, 4, 4, 8, 16, 8]
    import pyarrow as pa

    assert (whitening._unpacked(pa.array(packed, pa.binary()), 2) == y).all()
    big = whitening._centred(y, 10**6, [3 * 10**20, 5])
    assert big[4][0] == 10**6 * 2**40 - 3 * 10**20
