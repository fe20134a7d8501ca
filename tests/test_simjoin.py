"""Similarity joins against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from kindred.operators import gramindex, pairs, simjoin


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1 / 3, 0.95])
def test_set_join_equals_all_pairs(spark, threshold):
    rng = random.Random(int(threshold * 100))
    sets = {}
    while len(sets) < 180:
        if sets and rng.random() < 0.6:  # near another one
            s = set(rng.choice(list(sets.values())))
            for _ in range(rng.randint(1, 4)):
                s ^= {rng.randint(1, 60)}
        else:
            s = {min(rng.randint(1, 60), rng.randint(1, 60)) for _ in range(rng.randint(1, 25))}
        if s and s not in sets.values():
            sets[len(sets)] = s
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, s array<long>")
    found = {(r["left_id"], r["right_id"]): r["similarity"] for r in simjoin.set_join(df, threshold).collect()}
    wanted = {(a, b): jaccard(sets[a], sets[b]) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= threshold - 1e-12}
    assert found.keys() == wanted.keys() and wanted and all(abs(found[k] - v) < 1e-12 for k, v in wanted.items())


def test_near_copies_of_texts(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (2, text.upper() + " !"), (3, text + " tail"), (4, "head " + text + " tail x"), (5, None), (6, "..."), (7, "a b"), (8, "A, b"), (9, "quite another text than those")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = simjoin.shingle_sets(df, "doc_id", "text")
    found = {r["doc_id"]: (r["component_id"], r["links"]) for r in simjoin.near_copies(sets, "doc_id", "s").collect()}
    assert found == {1: (1, 2), 2: (1, 2), 3: (1, 2), 4: (1, 2), 5: (5, 0), 6: (6, 0), 7: (7, 0), 8: (7, 0), 9: (9, 0)}
    assert simjoin.near_copies(sets.limit(0), "doc_id", "s").count() == 0


def test_a_hot_element_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(pairs, "HEAVY", 10)
    df = spark.createDataFrame([(i, [1, 2, 3, 4, 100 + i]) for i in range(60)], "id long, s array<long>")
    assert simjoin.set_join(df, 0.6).count() == 60 * 59 // 2


def test_top_k_looks_at_few_and_finds_all(spark):
    rng = random.Random(3)
    rare = [f"r{i}" for i in range(300)]
    weights = lambda own: {g: rng.random() + (0.1 if g[0] == "c" else 2) for g in own}
    docs = {i: weights({*rng.sample(rare, 4), "c1", "c2", "c3"}) for i in range(400)}
    queries = {i: weights({*rng.sample(rare, 4), "c1", "c2"}) for i in range(60)} | {99: weights({"c3"}), 98: weights({"nowhere"})}
    table = lambda rows, name: spark.createDataFrame([(i, g, w) for i, own in rows.items() for g, w in own.items()], f"{name} long, gram string, w double")
    found = simjoin.top_k(table(queries, "left_id"), table(docs, "right_id"), 2).collect()
    wanted = set()
    for q, own in queries.items():
        scores = sorted((-round(sum(w * d.get(g, 0) for g, w in own.items()), 9), i) for i, d in docs.items())
        wanted |= {(q, i, r + 1) for r, (s, i) in enumerate(scores[:2]) if s < 0}
    assert {(r["left_id"], r["right_id"], r["rank"]) for r in found} == wanted
    compared = {r["left_id"]: r["compared"] for r in found}
    assert sum(compared[q] for q in range(60)) < 60 * 400 / 4  # all documents share c1 and c2


def test_first_candidates_of_equal_scores(spark):
    left = spark.createDataFrame([(1, "g", 1.0)], "left_id long, gram string, w double")
    right = spark.createDataFrame([(i, "g", 1.0) for i in range(50)], "right_id long, gram string, w double")
    assert [(r["right_id"], r["rank"]) for r in simjoin.top_k(left, right, 3).orderBy("rank").collect()] == [(0, 1), (1, 2), (2, 3)]
    assert simjoin.top_k(left.limit(0), right, 3).count() == 0 == simjoin.top_k(left, right.limit(0), 3).count()
    assert simjoin.top_k(left, right.select("right_id", "gram", F.col("w")), 100).count() == 50


def test_neighbours_of_texts_make_no_rows_of_their_grams(spark, monkeypatch):
    """A small right side is scored where the left texts are, with the results of the join; texts of one id are one text."""
    rng = random.Random(5)
    words = ["été", "naïve", "a", "bb", "İx", *["".join(rng.choices("abcd", k=rng.randint(1, 7))) for _ in range(40)]]
    text = lambda n: rng.choice([" ", "\t", "\n "]).join(rng.choices(words, k=n))
    left = spark.createDataFrame([*[(i, text(rng.randint(0, 30))) for i in range(60)], (7, text(5)), (90, None), (91, "zzzz qqqq"), (None, text(4))], "id long, text string")
    right = spark.createDataFrame([*[(f"r{i:02}", text(12)) for i in range(25)], ("s1", words[0]), ("s0", words[0].upper())], "id string, text string")
    of = lambda: {(r["left_id"], r["right_id"], r["rank"], round(r["score"], 9)) for r in pairs.tfidf_neighbours(left, right, "id", "text", "id", "text", 4).collect()}
    joined = []
    monkeypatch.setattr(simjoin, "top_k", lambda *a, whole=simjoin.top_k, **b: joined.append(1) or whole(*a, **b))
    found = of()
    assert not joined
    monkeypatch.setattr(gramindex, "MOST_ROWS", 3)
    assert found == of() and joined and len(found) > 200


@pytest.mark.parametrize("sizes", [(3, 4, 5), (5,), (6, 4)])
def test_hashes_of_a_text_are_those_of_its_grams(spark, sizes):
    texts = ["", " \n", "a", "a bb ccc\tdddd  été\u2003x", "\U0001f600 ab\U0001f600cdefgh"]
    grams = spark.createDataFrame([(t,) for t in texts], "t string").select("t", pairs.char_grams(F.col("t"), sizes).alias("g")).collect()
    for r in grams:
        wanted = sorted(int(gramindex._hashes(p := gramindex._points(g), len(p))[0]) for g in r["g"])
        assert sorted(gramindex.text_hashes(r["t"], sizes).tolist()) == wanted


def test_elements_of_one_set_do_not_meet(spark, monkeypatch):
    """Of 40 sets with 30 elements of their own and one common one, no element is shuffled to meet others."""
    df = spark.createDataFrame([(i, [7, *range(100 * (i + 1), 100 * (i + 1) + 30)]) for i in range(40)], "id long, s array<long>")
    sizes, whole = [], simjoin.dealt_join
    monkeypatch.setattr(simjoin, "dealt_join", lambda a, b, *more: sizes.append(b.count()) or whole(a, b, *more))
    assert simjoin.set_join(df, 0.8).count() == 0 and sizes == [0]


def test_only_sets_that_may_be_similar_are_kept_or_shuffled(spark, monkeypatch):
    """Of 60 texts of which four are alike, those four alone are written as sets; a class of copies counts once."""
    text = lambda k, n=60: " ".join(f"w{k}x{i}" for i in range(n))
    rows = [(i, text(i)) for i in range(56)] + [(i, text("a", n)) for i, n in ((56, 60), (57, 60), (58, 61), (59, 62), (60, 90))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tables, whole = {}, simjoin.written
    monkeypatch.setattr(simjoin, "written", lambda d, name: tables.setdefault(name, whole(d, name)))
    found, members = simjoin.class_join(df, "doc_id", "s", 0.8, lambda some, key: simjoin.shingle_sets(some, key, "text"))
    assert {(r["left_id"], r["right_id"]) for r in found.collect()} == {(56, 58), (56, 59), (58, 59)}
    assert {r["doc_id"]: r["id"] for r in members.collect()} == {i: 56 if i == 57 else i for i in range(61)}
    assert sorted(r["id"] for r in tables["candidate-sets"].select("id").collect()) == [56, 58, 59]
    # a prefix has a fifth of its set
    assert tables["prefixes"].filter("size(prefix) > n / 5 + 1").count() == 0
