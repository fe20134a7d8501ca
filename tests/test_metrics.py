import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions import compare as C
from kindred.operators import graph, metrics, score


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_curves_against_enumeration(spark, seed):
    g = random.Random(seed)
    data = [(g.choice([0.1, 0.2, 0.35, 0.5, 0.9]) if seed else g.random(), int(g.random() < 0.4)) for _ in range(120)]
    df = spark.createDataFrame(data, "score double, target int")
    row = metrics.curve_summary(metrics.score_counts(df)).first()
    pos, neg = [s for s, t in data if t], [s for s, t in data if not t]
    roc = np.mean([(p > n) + 0.5 * (p == n) for p, n in itertools.product(pos, neg)])
    points, last, area = [], 0.0, 0.0
    for t in sorted({s for s, _ in data}, reverse=True):
        tp, fp = sum(s >= t for s in pos), sum(s >= t for s in neg)
        precision, recall = tp / (tp + fp), tp / len(pos)
        area += (recall - last) * precision
        last = recall
        points.append((2 * precision * recall / max(precision + recall, 1e-12), -t))
    assert row["roc_auc"] == pytest.approx(roc) and row["pr_auc"] == pytest.approx(area)
    best = max(f for f, _ in points)
    assert row["best_pair_f1"] == pytest.approx(best)
    assert row["best_pair_threshold"] in [-t for f, t in points if abs(f - best) < 1e-12]
    hit = metrics.threshold_metrics(df, 0.5).first()
    assert (hit["tp"], hit["fp"], hit["fn"]) == (sum(s >= 0.5 for s in pos), sum(s >= 0.5 for s in neg), sum(s < 0.5 for s in pos))


def test_pairs_left_out_count_as_zero(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0)], "score double, target int")
    row = metrics.curve_summary(metrics.score_counts(df, missing_positives=1, missing_negatives=7)).first()
    assert row["n_pairs"] == 10 and row["prevalence"] == pytest.approx(0.2) and row["best_pair_threshold"] == 0.9


def test_one_class_has_no_areas(spark):
    row = metrics.curve_summary(metrics.score_counts(spark.createDataFrame([(0.9, 1)], "score double, target int"))).first()
    assert row["roc_auc"] is None and row["pr_auc"] is None


@pytest.mark.parametrize(("a", "b", "expected"), [("0011", "1100", 1.0), ("0011", "0101", -0.5), ("0000", "0123", 0.0), ("0123", "0123", 1.0)])
def test_adjusted_rand(spark, a, b, expected):
    df = spark.createDataFrame(list(zip(a, b)), "t string, p string")
    assert metrics.adjusted_rand(df, "t", "p").first()[0] == pytest.approx(expected)


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 40)], [(i, (i + 1) % 30) for i in range(30)], [(1, 1), (None, 3)], []])
def test_components_of_shapes(spark, edges):
    df = spark.createDataFrame(edges, "left_id long, right_id long")
    nodes = spark.range(45).withColumnRenamed("id", "record_id")
    found = {r["record_id"]: r["component_id"] for r in graph.component_labels(nodes, df).collect()}
    up = {i: i for i in range(45)}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    assert found == {i: root(i) for i in range(45)}


def test_components_at_random(spark):
    g = random.Random(5)
    edges = [(f"n{g.randrange(300):03d}", f"n{g.randrange(300):03d}") for _ in range(180)]
    roots = {r["node"]: r["root"] for r in graph.connected_components(spark.createDataFrame(edges, "left_id string, right_id string")).collect()}
    groups = {n: {n} for e in edges for n in e}
    for a, b in edges:
        if groups[a] is not groups[b]:
            groups[a] |= groups[b]
            for n in groups[b]:
                groups[n] = groups[a]
    for a, b in itertools.combinations(groups, 2):
        assert (roots[a] == roots[b]) == (groups[a] is groups[b])


def test_evaluate_and_its_error(spark):
    records = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "z")], "id int, entity_id string")
    scored = spark.createDataFrame([(1, 2, 0.9, 1), (3, 4, 0.2, 0)], "left_id int, right_id int, score double, target int")
    row = metrics.evaluate("b", records, "id", "entity_id", scored).first()
    assert (row["n_records"], row["n_entities"], row["pair_f1"], row["adjusted_rand"], row["true_pair_candidate_recall"]) == (4, 3, 1.0, 1.0, 1.0)
    with pytest.raises(ValueError, match="one class"):
        metrics.evaluate("b", records, "id", "id", scored.withColumn("target", F.lit(0)))


def test_agreement_counts_two_nulls_as_equal(spark):
    df = spark.createDataFrame([(None, None, "a", "b"), ("x", None, "a", "a")], "left_p string, right_p string, left_q string, right_q string")
    assert [(r["matching_fields"], r["differing_fields"]) for r in metrics.agreement(df, ["p", "q"]).collect()] == [(1, "q"), (1, "p")]


@pytest.mark.parametrize(("a", "b", "expected"), [("", "", 0.0), ("abc", "abc", 1.0), ("martha", "marhta", 0.961111), ("abcdef", "abzzzz", 0.555556), ("a", "b", 0.0)])
def test_jaro_winkler(a, b, expected):
    assert C.jaro_winkler_text(a, b) == pytest.approx(expected, abs=1e-6)


def test_comparison_plan():
    plan = C.comparison_plan({"state": "categorical", "email": "identifier", "dob": "text", "name": "text", "tel": "phone"})
    assert [plan[c][0] for c in ("state", "email", "dob", "name", "tel")] == ["exact", "email", "levenshtein", "jaro_winkler", "jaro_winkler"]


def test_em_finds_the_matches(spark):
    g = random.Random(3)
    rows = []
    for i in range(3000):
        match = i < 300
        rows.append((i, i, int(match), *[int(g.random() < (0.95 if match else 0.1)) for _ in range(4)]))
    names = [f"f{k}" for k in range(4)]
    df = spark.createDataFrame(rows, "left_id int, right_id int, truth int, " + ", ".join(f"gamma_{n} int" for n in names))
    plan = {n: ("exact", ()) for n in names}
    model = score.expectation_maximisation(df, plan, {n: [0.9, 0.1] for n in names}, 0.05)
    assert all(0.85 < model.m[n][1] < 1 for n in names)
    model.prior = 0.1
    out = model.predict(df)
    assert out.filter((F.col("score") > 0.5) == (F.col("truth") == 1)).count() > 2900


def test_logistic_orders_pairs(spark):
    df = spark.createDataFrame([(x / 10, int(x > 12)) for x in range(20)], "x double, target int")
    model = score.fit_logistic(df, ["x"])
    assert model.weights[0] > 0
    for target, wanted in ((0, 0.0), (1, 1.0)):  # one class only: a constant
        constant = score.fit_logistic(df.withColumn("target", F.lit(target)), ["x"]).score_pairs(df)
        assert all(abs(r["score"] - wanted) < 1e-12 for r in constant.collect())
    assert score.fit_logistic(df.limit(0), ["x"]).score_pairs(df.limit(0)).count() == 0


def test_quantiles_of_one_hot_group(spark, rows):
    rng = np.random.default_rng(2)
    values = [("hot", float(v)) for v in rng.integers(0, 400, 3000) / 7] + [("few", 1.0), ("few", 4.0), (None, 5.0), ("none", None)] + [("same", 2.5)] * 500
    df = spark.createDataFrame(values, "g string, v double").repartition(7)
    shares = (0.0, 0.25, 0.5, 0.9, 1.0)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    try:
        found = {r[0]: r[1:] for r in metrics.grouped_quantiles(df, ["g"], "v", shares).collect()}
        (whole,) = metrics.grouped_quantiles(df, [], "v", shares).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    own = {}
    for g, v in values:
        if v is not None:
            own.setdefault(g, []).append(v)
    assert found.keys() == own.keys()
    for g, x in own.items():
        assert found[g] == pytest.approx(np.quantile(x, shares))
    assert tuple(whole) == pytest.approx(np.quantile(sum(own.values(), []), shares))
