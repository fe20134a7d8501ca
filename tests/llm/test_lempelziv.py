"""Repeated passages against a plain index of all windows."""

import random
import re

import pytest

from kindred.llm import lempelziv


def brute(rows, window=20):
    """(id, n_words, n_removed, kept) of each row, by the places of every window."""
    order = lambda i: (i is not None, i)
    texts = [(i, re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in rows]
    first = {}
    for i, w in texts:
        for s in range(len(w) - window + 1):
            key, place = tuple(w[s : s + window]), (order(i), s)
            first[key] = min(first.get(key, place), place)
    out = []
    for i, w in texts:
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (order(i), s):
                gone.update(range(s, s + window))
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def check(spark, rows, window=20, seed=8, schema="doc_id long, text string", parts=5):
    df = spark.createDataFrame(rows, schema).repartition(parts)
    found = lempelziv.parse(df, window=window, seed=seed).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in found), key=repr) == sorted(brute([r[:2] for r in rows], window), key=repr)
    return found


def passages(rng, n, vocabulary, length):
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, length))) for _ in range(n)]


@pytest.mark.parametrize("window,seed,words", [(20, 8, 400), (5, 2, 30), (6, 6, 4), (4, 1, 3)])
def test_equals_brute_force(spark, window, seed, words):
    rng = random.Random(window)
    vocabulary = [f"w{i}" for i in range(words)]
    shared = passages(rng, 12, vocabulary, 4 * window)
    rows = []
    for i in range(150):
        parts = passages(rng, rng.randint(0, 3), vocabulary, 2 * window)
        parts += rng.sample(shared, rng.randint(0, 3))
        rng.shuffle(parts)
        rows.append((i * 7 % 150, rng.choice([" ", "\n", "\t \x0b"]).join(parts)))
    rows += [(200 + i, rows[i][1]) for i in range(10)]
    check(spark, rows, window, seed)


def test_hot_passage_over_many_blocks(spark):
    rng = random.Random(9)
    hot = passages(rng, 1, [f"h{i}" for i in range(90)], 1)[0] + " " + " ".join(f"h{i}" for i in range(35))
    rows = [(i, " ".join([*(f"a{rng.randint(0, 9)}" for _ in range(rng.randint(0, 5))), hot, *(f"b{rng.randint(0, 3)}" for _ in range(rng.randint(0, 30)))])) for i in range(300)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        check(spark, rows, parts=9)
        check(spark, [(i, "same " * 40) for i in range(60)], parts=9)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_factors_are_copies(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)]
    shared = passages(rng, 6, vocabulary, 60)
    rows = [(i, " ".join(rng.sample(shared, 3) + passages(rng, 1, vocabulary, 20))) for i in range(60)]
    words = {i: t.split() for i, t in rows}
    found = check(spark, rows, 8, 3)
    assert any(r["factors"] for r in found)
    for r in found:
        for f in r["factors"]:
            mine, other = words[r["doc_id"]], words[f["source_id"]]
            assert f["length"] >= 8 and (f["source_id"], f["source_start"]) < (r["doc_id"], f["start"])
            assert mine[f["start"] : f["start"] + f["length"]] == other[f["source_start"] : f["source_start"] + f["length"]]


def test_odd_rows(spark):
    assert lempelziv.parse(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text, "x", 1), (None, None, "x", 1), (3, "", None, None), (3, text + " tail", "", 2), (3, text, "", 2), (3, text, "", 2), (4, " \x1c" + text.replace("w3", " "), "", 2), (5, "x " * 50_000 + text, "", 0)]
    schema = "doc_id long, text string, hash string, place int"
    check(spark, rows, schema=schema)
    check(spark, [(str(a) if a else a, *r) for a, *r in rows], schema=schema.replace("doc_id long", "doc_id string"))


def test_rows_that_share_an_id(spark):
    """They are one document laid over itself: the earlier start is the earlier one, in whichever row it is."""
    text = " ".join(f"w{i}" for i in range(25))
    rows = [(1, "a b " + text), (1, text), (1, text), (1, "c " + text)]
    found = {(r["n_words"], r["n_removed"]) for r in check(spark, rows)}
    assert found == {(27, 25), (25, 0), (26, 25)}
