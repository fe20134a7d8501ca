"""Queries and operators on tables that large inputs are like: copies of values, odd numbers, more pairs than a limit."""

import pytest
from pyspark.sql import functions as F

from kindred import queries
from kindred.operators import views

from .oracle import connect, table


def same_as_sql(spark, folder, name):
    found = queries.queries()[name](spark, str(folder)).toPandas()
    wanted = connect(str(folder)).execute(queries.oracle_sql()[name]).fetchdf()
    assert len(found) and table(found) == table(wanted)


@pytest.fixture
def folder(spark, tmp_path):
    balances = [-0.3, 0.2, 0.0, -0.5, -0.6, 1.5, 9.4, -9.6, -0.2, 120.0]
    spark.createDataFrame([(i, f"Supplier#{i:09d}", i % 3, balances[i % 10]) for i in range(60)], "s_suppkey long, s_name string, s_nationkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(i, i % 3, balances[i % 10] + i % 4) for i in range(80)], "c_custkey long, c_nationkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    return tmp_path


def test_balances_that_round_to_zero_from_below(spark, folder):
    same_as_sql(spark, folder, "gamma_counts_supplier")


def test_levels_are_counted_without_rows_of_pairs(spark, rows, monkeypatch):
    """Counts by tiles of classes are those of all pairs, copies and missing values included; no pair is a row."""
    import random

    from kindred.operators import pairs, score

    g = random.Random(4)
    texts = [None, "", "ab", "ba@x", "abc" * 30, *["Supplier" + "".join(g.choices("0123", k=g.randint(1, 5))) for _ in range(30)]]
    df = spark.createDataFrame([(i, g.choice(["a", "b", "", None]), g.choice(texts), g.choice(texts), g.choice([1, 2, None])) for i in range(150)], "id long, block string, a string, b string, c int")
    plan = {"a": ("jaro_winkler", (0.95, 0.9, 0.8)), "b": ("levenshtein", (1, 2)), "c": ("exact", ())}
    wanted = rows(score.gamma_counts(score.add_gammas(pairs.blocked_pairs(df, "id", ["block"], list(plan)), plan), list(plan)))
    monkeypatch.setattr(pairs, "blocked_pairs", None)
    for part, most in ((2048, 1 << 22), (9, 100)):
        monkeypatch.setattr(score, "_PART", part)
        monkeypatch.setattr(score, "_PAIRS", most)
        assert rows(score.block_gamma_counts(df, "block", plan)) == wanted


def test_gamma_counts_have_no_limit_of_pairs(spark, folder, monkeypatch):
    from kindred.operators import pairs

    monkeypatch.setattr(pairs, "blocked_pairs", None)
    same_as_sql(spark, folder, "gamma_counts_supplier")


def test_texts_are_compared_many_at_once():
    import random

    from kindred.functions import compare as C

    g = random.Random(2)
    for letters in ("ab", "0123456789", "aé😀"):
        for begin in ("", "ababab"):
            a, b = ([begin + "".join(g.choices(letters, k=g.choice([0, 3, 9, 40, 70]))) for _ in range(15)] for _ in range(2))
            a, b = sorted(set(a)), sorted({*b, *a[:3]})
            found = C.level_matrix("jaro_winkler", (0.95, 0.9, 0.8), a, b)
            assert [[4 if x == y else sum(C.jaro_winkler_text(x, y) >= t for t in (0.95, 0.9, 0.8)) for y in b] for x in a] == found.tolist()


@pytest.mark.parametrize("name", ["score_linkage_customer_supplier", "score_linkage_blocked"])
def test_linkage_of_equal_values(spark, folder, name):
    same_as_sql(spark, folder, name)


def test_equal_rows_are_scored_once(spark):
    left, right = (spark.range(n).select("id", (F.col("id") % 5).alias("v"), F.lit(1).alias("b")) for n in (3000, 2000))
    scored = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(a, b):
        scored.add(1)
        return float(-abs(a - b))

    for block in ([], ["b"]):
        found = views.score_linkage(left, right, lambda _: score("left_v", "right_v"), "id", "id", ["v", "b"], 7, block, most=None)
        assert [(r["left_index"], r["right_index"]) for r in found.collect()] == [(0, 5 * i) for i in range(7)]
    assert scored.value <= 4 * 25


def test_whole_jobs_have_no_limit_of_pairs(spark, folder, monkeypatch):
    from kindred.operators import pairs

    monkeypatch.setattr(pairs.cross_source_pairs, "__defaults__", ((), 10))
    same_as_sql(spark, folder, "cross_source_pairs_supplier")


def test_a_closure_broadcasts_nothing(spark, monkeypatch):
    from kindred.operators import dag

    plans = []

    def watched(df, name, write=dag.written):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(dag, "written", watched)
    edges = spark.range(2, 40).select(F.expr("id div 2").alias("parent"), F.col("id").alias("child"))
    found = dag.closure(edges, spark.range(30, 40).select(F.col("id").alias("node")), up=True, blocked=spark.range(4, 5).select(F.col("id").alias("node")))
    assert {(r["start"], r["node"], r["distance"]) for r in found.collect() if r["start"] in (30, 36)} == {(30, 15, 1), (30, 7, 2), (30, 3, 3), (30, 1, 4), (36, 18, 1), (36, 9, 2)}
    assert len(plans) > 5 and not any("Broadcast" in p for p in plans)


def test_models_are_compared_on_the_same_batches(spark):
    import numpy as np

    from kindred.operators import score, training

    g = np.random.default_rng(1)
    rows = []
    for i in range(240):
        a = g.normal(size=4)
        rows.append((i, i + 1000, int(i % 2), a.tolist(), (a + g.normal(size=4) * (0.1 if i % 2 else 1)).tolist()))
    df = spark.createDataFrame(rows, "left_id long, right_id long, target int, left_embedding array<double>, right_embedding array<double>")
    batches = training.Batches.write(df, "embedding", 40)
    start = score.PairMLP.random(4)
    model, state = training.train(start, batches, spark, steps=6, rate=1e-2)
    assert training.improved(start, model, batches, spark, 6) and not training.improved(model, start, batches, spark, 6)
    # what steps report is each of another batch: no model is better than itself, whatever the batches
    assert not training.improved(start, start, batches, spark, 6)


@pytest.mark.parametrize("sizes", [(6, 5, 1), (6, 4, 3, 1), (6, 1)])
def test_the_best_pairs_of_a_network_make_no_rows_of_the_others(spark, sizes):
    import numpy as np

    from kindred.operators import pairs, score

    g = np.random.default_rng(len(sizes))
    model = score.PairMLP([(g.normal(size=s), g.normal(size=s[1])) for s in zip(sizes, sizes[1:])])
    df = spark.createDataFrame([(i, g.normal(size=6).tolist()) for i in range(600)], "id long, embedding array<double>")
    found = model.best_pairs(df, "id", 8)
    assert found.count() <= 8 * 6  # three tiles, or six
    wanted = views.top_pairs(model.score_pairs(pairs.all_pairs(df, "id", ["embedding"])), 8).collect()
    assert [(r[0], r[1], round(r[2], 9)) for r in views.top_pairs(found, 8).collect()] == [(r[0], r[1], round(r[2], 9)) for r in wanted]
