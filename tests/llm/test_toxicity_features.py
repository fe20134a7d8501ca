import numpy as np

from kindred.llm import toxicity


def test_grams_of_three_to_six_letters():
    points = " abcdefgh "
    assert len(toxicity.features("abcdefgh")) == sum(len(points) - n + 1 for n in (3, 4, 5, 6))
    assert toxicity.SAMPLE == 8000


def test_packed_rows_are_the_rows():
    g = np.random.default_rng(2)
    rows = [np.sort(g.choice(1 << 18, n, replace=False)).astype(np.int32) for n in (0, 1, 3, 5000)]
    kept = toxicity.Packed([toxicity.packed(x) for x in rows])
    assert len(kept) == 4 and all(np.array_equal(a, kept[i]) for i, a in enumerate(rows))
    labels = np.arange(60) % 2
    rows = [np.unique(g.integers(0, 900, 40) + 900 * y).astype(np.int32) for y in labels]
    a, b = toxicity.fit(rows, labels), toxicity.fit(toxicity.Packed([toxicity.packed(x) for x in rows]), labels)
    assert np.array_equal(a[0], b[0]) and a[1] == b[1]
