"""The neighbour index against all cosines."""

import numpy as np
import pytest

from kindred.operators import neighbours


def brute(rows, queries, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    score = np.round(x @ x.T, 6)
    out = set()
    for q in queries:
        at = int(np.flatnonzero(ids == q)[0])
        order = sorted((-score[at, j], ids[j]) for j in range(len(ids)) if j != at)[:k]
        out |= {(int(q), int(i), r + 1, round(-s, 6)) for r, (s, i) in enumerate(order)}
    return out


def clustered(seed, n, width=16, groups=12, spread=0.6):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, width))
    return [(i, (middles[rng.integers(groups)] + spread * rng.normal(size=width)).tolist()) for i in range(n)]


def found(df):
    return {(r["query_index"], r["neighbor_index"], r["rank"], round(r["score"], 6)) for r in df.collect()}


def test_exact_search_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CHUNK", 40)
    rows = clustered(1, 600)
    rows += [(1000 + i, rows[5][1]) for i in range(30)] + [(2000 + i, rows[7][1]) for i in range(2)]  # copies
    df = spark.createDataFrame(rows, "id long, v array<double>")
    index = neighbours.build(df, "id", "v", k=4)
    asked = [i for i, _ in rows if i % 10 == 5 or i >= 1000]
    assert found(index.search(df.filter("id % 10 = 5 or id >= 1000"), "id", "v", exact=True)) == brute(rows, asked, 4)
    wanted = sorted({(min(a, b), max(a, b), s) for a, b, _, s in brute(rows, [i for i, _ in rows], 40)}, key=lambda p: (-p[2], p[0], p[1]))[:4]
    assert [tuple(r) for r in index.top_pairs(4).collect()] == wanted


def test_recall_of_visited_cells(spark):
    rows = clustered(2, 4000, spread=0.9)
    df = spark.createDataFrame(rows, "id long, v array<double>")
    index = neighbours.build(df, "id", "v", k=3, sample=2000)
    assert index.visit < len(index.centroids) / 2
    asked = df.filter("id % 50 = 0")
    row = neighbours.recall(index.search(asked, "id", "v"), index.search(asked, "id", "v", exact=True)).first()
    assert row["n_wanted"] == 240 and row["recall"] >= 0.95


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [1.0, 1.0]), ("d", None), ("e", [0.0, 0.0]), ("f", [nan, 1.0]), ("g", [inf, 1.0]), ("h", [None, 1.0]), (None, [1.0, 0.0]), ("i", [1e300, 1e300])]
    df = spark.createDataFrame(rows, "id string, v array<double>")
    index = neighbours.build(df, "id", "v", k=2)
    assert found(index.search(df, "id", "v", exact=True)) == {("a", "b", 1, 1.0), ("a", "c", 2, 0.707107), ("b", "a", 1, 1.0), ("b", "c", 2, 0.707107), ("c", "i", 1, 1.0), ("c", "a", 2, 0.707107), ("i", "c", 1, 1.0), ("i", "a", 2, 0.707107)}
    with pytest.raises(ValueError, match="2 ids"):
        index.top_pairs(3)
    none = neighbours.build(df.limit(0), "id", "v", k=2)
    assert none.search(df, "id", "v", exact=True).count() == 0 and none.top_pairs(1).count() == 0


@pytest.mark.parametrize("spread", [0.05, 2.0])
def test_top_pairs_meet_in_tiles(spark, monkeypatch, spread):
    """Groups meet, vectors aren't sent to each cell; of vectors that cluster few groups do. Copies and ids as text included."""
    for name, value in (("GROUP", 64), ("SLICE", 16), ("PACK", 10)):
        monkeypatch.setattr(neighbours, name, value)
    monkeypatch.setattr(neighbours.Index, "_compared", None)
    rows = [(f"r{i}", v) for i, v in clustered(3, 500, spread=spread)]
    rows += [(f"c{i}", rows[9][1]) for i in range(3)]
    index = neighbours.build(spark.createDataFrame(rows, "id string, v array<double>"), "id", "v", k=9)
    met, whole = [], neighbours.Index._tiles
    monkeypatch.setattr(neighbours.Index, "_tiles", lambda self, *a: met.append(whole(self, *a)) or met[0])
    x = np.array([v for _, v in rows])
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    score = np.round(x @ x.T, 6)
    pairs = [(*sorted((rows[i][0], rows[j][0])), float(score[i, j])) for i in range(len(rows)) for j in range(i + 1, len(rows))]
    wanted = sorted(pairs, key=lambda p: (-p[2], p[0], p[1]))[:9]
    assert [(a, b, round(s, 6)) for a, b, s in map(tuple, index.top_pairs(9).collect())] == wanted
    assert len(met[0]) < 60 if spread < 1 else len(met[0]) == 120, len(met[0])
