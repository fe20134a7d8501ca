import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from kindred.operators import metrics, pairs, score, views


@pytest.fixture
def scored(spark):
    return spark.createDataFrame([("r0", "r1", 0.9), ("r0", "r2", 0.1), ("r1", "r2", 0.2)], "left_id string, right_id string, score double")


@pytest.fixture
def records(spark):
    return spark.createDataFrame([("r0", "Ada", "a@x.org"), ("r1", "A.", "a@x.org"), ("r2", "Grace", "g@x.org")], "id string, name string, email string")


def test_top_pairs(scored):
    assert [tuple(r) for r in views.top_pairs(scored, 1).collect()] == [("r0", "r1", 0.9)]


def test_neighbours_from_both_sides(scored):
    first = {r["query_index"]: (r["neighbor_index"], r["rank"]) for r in views.nearest_neighbors(scored, 1).collect()}
    assert first == {"r0": ("r1", 1), "r1": ("r0", 1), "r2": ("r1", 1)}


def test_review_has_both_sides(scored, records):
    row = views.pair_review_table(scored, records, "id", 1).first()
    assert (row["left_name"], row["right_name"], row["score"]) == ("Ada", "A.", 0.9)


def test_missing_scores_come_last(spark):
    df = spark.createDataFrame([(1, 2, float("nan")), (1, 3, None), (1, 4, 0.5), (1, 5, 0.5)], "left_id int, right_id int, score double")
    assert [r["right_index"] for r in views.top_pairs(df, 4).collect()][:2] == [4, 5]


def test_no_records(spark, scored, records):
    assert views.top_pairs(scored.limit(0)).collect() == []
    assert pairs.all_pairs(records.limit(1), "id").count() == 0


def linkage(spark, left_rows=(("l0", "Ada", "a"), ("l1", "Grace", "g"))):
    left = spark.createDataFrame(list(left_rows), "lid string, full_name string, email string")
    right = spark.createDataFrame([("r0", "Ada", "a"), ("r1", "Grace", "x")], "rid string, customer string, mail string")
    columns = {"name": ("full_name", "customer"), "email": ("email", "mail")}
    return views.score_linkage(left, right, lambda names: score.evidence(names), "lid", "rid", columns, 2)


def test_linkage(spark):
    out = linkage(spark).collect()
    assert [(r["left_index"], r["right_index"], r["score"]) for r in out] == [("l0", "r0", 1.0), ("l1", "r1", 0.5)]
    assert out[0]["left_name"] == "Ada" and out[1]["right_email"] == "x"


def test_linkage_of_empty_table(spark):
    out = linkage(spark, ())
    assert out.columns == ["left_index", "right_index", "score", "left_name", "right_name", "left_email", "right_email"] and not out.collect()


def test_linkage_columns(spark, records):
    with pytest.raises(TypeError, match="not a string"):
        views.resolve_linkage_columns(records, records, "name")
    with pytest.raises(ValueError, match="not in the right"):
        views.resolve_linkage_columns(records, records.drop("email"), ["email"])
    with pytest.raises(ValueError, match="in common"):
        views.resolve_linkage_columns(records.select("name"), records.select("email"))
    with pytest.raises(ValueError):
        views.score_linkage(records, records, lambda n: F.lit(1.0), "id", "id", ["name"], 0)


def test_blocking_rules_keep_each_pair_once(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "x"), (4, None, ""), (5, None, "")], "id int, p string, q string")
    out = sorted(tuple(r) for r in pairs.blocked_pairs(df, "id", ["p", "q"]).select("left_id", "right_id", "match_key").collect())
    assert out == [(1, 2, "exact:p"), (1, 3, "exact:q"), (2, 3, "exact:q")]


def test_all_pairs_guard(spark, records):
    with pytest.raises(ValueError, match="block them"):
        pairs.all_pairs(records, "id", most=2)


def test_paired_rows_drop_malformed_groups(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "a", "x"), (3, "a", "x"), (3, "a", "y"), (None, "a", "z"), (None, "b", "z")], "p int, s string, v string")
    assert [tuple(r) for r in pairs.paired_rows(df, "p", "s", "a", "b", ["v"]).collect()] == [(1, "x", "y")]


def test_char_grams(spark):
    out = spark.createDataFrame([("Ab c",)], "t string").select(pairs.char_grams(F.col("t"))).first()[0]
    assert sorted(out) == sorted([" ab", "ab ", " ab ", " c "])


def test_splits_never_overlap(spark):
    df = spark.createDataFrame([(i, i + 1, int(i < 10)) for i in range(60)], "left_id int, right_id int, label int")
    out = pairs.split_pairs(df, {"train": 20, "valid": 1, "test": 8})
    counts = {r["split"]: (r["pairs"], r["p"]) for r in out.groupBy("split").agg(F.count("*").alias("pairs"), F.sum("label").alias("p")).collect()}
    assert counts == {"train": (20, 6), "valid": (2, 2), "test": (8, 2)}
    assert out.select("left_id").distinct().count() == 30


@pytest.mark.parametrize("block", [256, 5])
def test_cosines_in_blocks(spark, block):
    g = random.Random(block)
    vectors = [(i, [g.gauss(0, 1) for _ in range(6)], g.choice(["x", "y", None])) for i in range(40)] + [(40, [0.0] * 6, "x"), (41, None, "x")]
    df = spark.createDataFrame(vectors, "id long, v array<double>, l string").repartition(3)
    found = {(r["left_id"], r["right_id"]): (r["score"], r["target"]) for r in pairs.cosine_pairs(df, "id", "v", "l", block=block).collect()}
    assert len(found) == 42 * 41 // 2
    for (i, a, s), (j, b, t) in itertools.combinations(vectors, 2):
        score, target = found[i, j]
        norm = a and b and (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        assert target == int(s is not None and s == t)
        assert score is None if norm is None else score == pytest.approx(sum(x * y for x, y in zip(a, b)) / norm if norm else 0)
    assert pairs.cosine_pairs(df.limit(0), "id", "v").count() == 0 and pairs.cosine_pairs(df, "id", "v").columns == ["left_id", "right_id", "score"]
    with pytest.raises(ValueError, match="over the limit"):
        pairs.cosine_pairs(df, "id", "v", most=10)
    with pytest.raises(ValueError, match="length"):
        pairs.cosine_pairs(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, v array<double>"), "id", "v")


def test_ids_that_are_texts(spark):
    df = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 1.0]), ("c", [0.0, 2.0])], "id string, v array<double>")
    found = {(r["left_id"], r["right_id"]): round(r["score"], 6) for r in pairs.cosine_pairs(df, "id", "v").collect()}
    assert found == {("a", "b"): 0.707107, ("a", "c"): 0.707107, ("b", "c"): 0.0}


def test_pairs_are_chosen_and_counted_where_they_are_made(spark, rows):
    g = random.Random(3)
    some = [[g.gauss(0, 1) for _ in range(4)] for _ in range(12)]
    df = spark.createDataFrame([(i, some[i % 12] if i % 9 else None, i % 3, i % 2) for i in range(60)], "id long, v array<float>, l int, s int")
    every = pairs.cosine_pairs(df, "id", "v", "l", digits=6)
    of = lambda **k: pairs.cosine_pairs(df, "id", "v", "l", block=7, digits=6, **k)
    for kinds in ([(None, True)], [(0, True), (1, False), (1, True), (0, False)]):
        found = of(keep=pairs.ends(8, *kinds))
        assert found.count() < every.count() and found.distinct().count() == found.count()
        assert rows(views.top_pairs(found, 8)) == rows(views.top_pairs(every, 8)) if len(kinds) == 1 else rows(metrics.confident_pairs(found, 8)) == rows(metrics.confident_pairs(every, 8))
    assert rows(views.nearest_neighbors(of(keep=pairs.nearest(3)), 3)) == rows(views.nearest_neighbors(every, 3))
    assert rows(of(keep=pairs.from_score(0.4))) == rows(every.filter("score >= 0.4")) and rows(of(keep=pairs.of_target(1))) == rows(every.filter("target = 1"))
    for apart in (None, "s"):
        wanted = every.filter("left_id % 2 <> right_id % 2") if apart else every
        counts = pairs.cosine_counts(df, "id", "v", "l", block=7, apart=apart)
        assert rows(counts, "score", "target", "n") == rows(wanted.groupBy("score", "target").agg(F.count("*").alias("n")))
        assert rows(of(apart=apart)) == rows(wanted)
    for f in (lambda x, c: metrics.threshold_metrics(x, 0.5, 0, c), lambda x, c: metrics.score_stats(x, ["target"], c), lambda x, c: metrics.curve_summary(metrics.score_counts(x.filter("score is not null"), count=c)), lambda x, c: metrics.candidate_stats(x, 60, 7, count=c)):
        for a, b in zip(rows(f(pairs.cosine_counts(df, "id", "v", "l"), "n")), rows(f(every, None))):
            assert list(a) == pytest.approx(list(b))
    with pytest.raises(ValueError, match="over the limit"):
        pairs.cosine_counts(df, "id", "v", "l", most=10)


def test_splits_by_keys_equal_splits_by_places(spark):
    df = spark.createDataFrame([(i, i + 1, int(i % 3 == 0)) for i in range(4000)], "left_id int, right_id int, label int")
    key = lambda r: (hashlib.md5(f"{r[0]}:{r[1]}:0".encode()).hexdigest(), r[0], r[1])
    data = df.collect()
    p, n = (sorted((tuple(r) for r in data if r[2] == t), key=key) for t in (1, 0))
    a, b = int(0.6 * len(p)), int(0.8 * len(p))
    quota = [max(0, 900 - a), max(0, 500 - (b - a)), max(0, 300 - (len(p) - b))]
    stop = [0, *itertools.accumulate(quota)]
    wanted = {s: {*p[i:j], *n[stop[k] : stop[k + 1]]} for k, (s, i, j) in enumerate((("train", 0, a), ("valid", a, b), ("test", b, len(p))))}
    found = pairs.split_pairs(df, {"train": 900, "valid": 500, "test": 300}).collect()
    assert len(found) == sum(map(len, wanted.values()))
    for s, some in wanted.items():
        assert {(r["left_id"], r["right_id"], r["label"]) for r in found if r["split"] == s} == some
