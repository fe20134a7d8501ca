"""Whitening against numpy's eigenvalues."""

import math

import numpy as np

from kindred.llm import whitening


def brute(rows, most=32):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in kept], object)
    n, s = len(x), x.sum(axis=0)
    centred = ((n * x - s) / n).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:most]
    out = {}
    for j, (i, _) in enumerate(kept):
        out[i] = (n, int(((n * x[j] - s) ** 2).sum()), centred[j] @ vectors[:, order] / np.sqrt(values[order]), values[order] / values.sum())
    return out


def test_equals_eigenvectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=40) * np.linspace(5, 0.3, 40) + 7]) for i in range(700)]
    rows += [(1000, None), (1001, [None] + [1.0] * 39), (1002, [float("nan")] + [1.0] * 39), (1003, [float("inf")] * 40), (1004, [1.0, 2.0]), (1005, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(37)
    found = whitening.whiten(df).collect()
    wanted = brute([r for r in rows if r[0] < 1004])
    assert len(found) == 700 * 32 and {r["vec_id"] for r in found} == set(wanted)
    got = {}
    for r in found:
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    signs = None
    for i, (n, deviation, white, share) in wanted.items():
        mine = got[i]
        assert sorted(mine) == list(range(1, 33))
        assert all(r["n"] == n == 700 and r["deviation"] == deviation and r["identity_error"] < 1e-9 for r in mine.values())
        w = np.array([mine[c]["whitened"] for c in range(1, 33)])
        signs = np.sign(w * white) if signs is None else signs
        assert np.allclose(w * signs, white, rtol=1e-6, atol=1e-8)
        assert np.allclose([mine[c]["explained"] for c in range(1, 33)], share, rtol=1e-9)


def test_jacobi_keeps_small_values():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(9, 9)))[0]
    wanted = 10.0 ** -np.arange(9)
    values, vectors = whitening.jacobi(np.diag(wanted) @ q.T)
    assert np.allclose(values, wanted, rtol=1e-10)
    assert np.allclose(vectors.T @ vectors, np.eye(9), atol=1e-13)
    assert np.allclose(np.abs((vectors * q).sum(axis=0)), 1)


def test_tall_trees_of_triangles(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FANIN", 2)
    monkeypatch.setattr(whitening, "BLOCK", 3)
    rng = np.random.default_rng(5)
    data = rng.normal(size=(60, 5)) * 40
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>").repartition(11)
    rows, width = whitening.usable(df)
    fitted = whitening.fit(rows, width)
    x = np.floor(data * 64)
    assert np.allclose(fitted.deviations**2, np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1], rtol=1e-10)


def test_odd_rows(spark):
    schema = "vec_id string, embedding array<float>, identity_error int, component string"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    same = [("a", [1.0, 2.0], 1, "x"), ("a", [1.0, 2.0], 1, "x"), (None, [1.0, 2.0], None, None)]
    assert whitening.whiten(spark.createDataFrame(same, schema)).count() == 0
    line = [*same, ("b", [2.0, 2.0], 0, ""), ("c", [3.0, 1.0, 1.0], 0, "")]
    found = whitening.whiten(spark.createDataFrame(line, schema)).collect()
    assert [(r["vec_id"], r["component"], r["n"]) for r in sorted(found, key=lambda r: r["vec_id"] or "")] == [(None, 1, 4), ("a", 1, 4), ("a", 1, 4), ("b", 1, 4)]
    assert sorted(r["deviation"] for r in found) == [64**2] * 3 + [(3 * 64) ** 2]
    assert all(abs(r["explained"] - 1) < 1e-12 for r in found)
    huge = [("a", [1e30, 0.0], 0, ""), ("b", [-1e30, 1.0], 0, ""), ("c", [0.0, 5.0], 0, "")]
    assert {r["deviation"] for r in whitening.whiten(spark.createDataFrame(huge, schema)).collect() if r["vec_id"] != "c"} == {None}


def test_deviations_beyond_longs_are_exact():
    x = np.array([[10**9, -5], [3, 4]], np.int64)
    c = whitening.Centre(10**9, [10**18 + 7, 12])
    assert c.deviations(x) == [sum((10**9 * int(a) - s) ** 2 for a, s in zip(r, c.sums)) for r in x.tolist()]
