"""Queries that do the whole job, against brute force."""

import itertools
import math
import random

import pytest

from kindred import queries
from kindred.operators import pairs, score


def components(nodes, edges):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def adjusted_rand(labels, found):
    tp = fp = fn = tn = 0
    for a, b in itertools.combinations(labels, 2):
        same, linked = labels[a] == labels[b], found[a] == found[b]
        tp, fp, fn, tn = tp + (same and linked), fp + (linked and not same), fn + (same and not linked), tn + (not same and not linked)
    return 2 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn))


def test_all_pairs_at_the_threshold_are_linked(spark, tmp_path):
    """Five groups of 20 near vectors make 950 links, more than 300."""
    g = random.Random(6)
    vectors = {}
    for i in range(100):
        v = [g.gauss(0, 0.07) for _ in range(8)]
        v[i % 5] += 1
        vectors[i] = v
    labels = {i: f"l{i % 5 if i < 90 else 0}" for i in vectors}
    spark.createDataFrame([(i, v, labels[i]) for i, v in vectors.items()], "vec_id long, embedding array<float>, label string").write.parquet(f"{tmp_path}/embeddings.parquet")
    norm = lambda v: sum(x * x for x in v) ** 0.5
    edges = [(a, b) for a, b in itertools.combinations(vectors, 2) if sum(x * y for x, y in zip(vectors[a], vectors[b])) / norm(vectors[a]) / norm(vectors[b]) >= 0.4]
    want = components(vectors, edges)
    assert len(edges) > 900 and len(set(want.values())) == 5
    found = queries.queries()["components_embeddings"](spark, str(tmp_path)).collect()
    assert {r["record_id"]: r["component_id"] for r in found} == want
    row = queries.queries()["adjusted_rand_embeddings"](spark, str(tmp_path)).first()
    assert row["adjusted_rand"] == pytest.approx(adjusted_rand(labels, want), abs=1e-8)


def test_agreement_on_rare_values_weighs_more(spark):
    """A fit counts categorical values over the whole table; agreement weighs log2(m / share), on values it doesn't know log2(m / u)."""
    values = ["hot"] * 40 + ["warm"] * 15 + ["rare"] * 2 + [None] * 3
    records = spark.createDataFrame([(i, v, i % 7) for i, v in enumerate(values)], "id long, seg string, n int")
    model = score.fit_fellegi_sunter(records, "id", {"seg": "categorical", "n": "numeric"})
    assert list(model.frequencies) == ["seg"]
    data = [(0, 1, "hot", "hot"), (2, 3, "rare", "rare"), (4, 5, "hot", "rare"), (6, 7, "new", "new"), (8, 9, None, None)]
    scored = model.score_pairs(spark.createDataFrame([(*x, 1, 2) for x in data], "left_id long, right_id long, left_seg string, right_seg string, left_n int, right_n int"), {"seg": "categorical", "n": "numeric"})
    got = {r["left_id"]: r["match_weight"] for r in scored.collect()}
    m, u = model.m["seg"], model.u["seg"]
    base = math.log2(model.prior / (1 - model.prior)) + math.log2(model.m["n"][0] / model.u["n"][0])
    want = {0: math.log2(m[1] / (40 / 57)), 2: math.log2(m[1] / (2 / 57)), 4: math.log2(m[0] / u[0]), 6: math.log2(m[1] / u[1]), 8: 0.0}
    assert got == {k: pytest.approx(base + v) for k, v in want.items()}


def test_blocks_are_purged_by_the_rule(spark, tmp_path):
    """Even blocks of 15 rows are all kept, as the rule has it; a cap of 12 keeps none."""
    spark.createDataFrame([(i, f"w{i // 15} own{i}") for i in range(60)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = queries.queries()["purged_block_filtering_benchmark"](spark, str(tmp_path)).collect()
    assert sorted((r["id"], r["token"], r["n"]) for r in found) == [(i, f"w{i // 15}", 15) for i in range(60)]
    assert queries.queries()["purged_edge_pruning_benchmark"](spark, str(tmp_path)).count() == 4 * (15 * 14 // 2)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_purge_limit_against_brute_force(spark, seed):
    g = random.Random(seed)
    blocks = {f"t{k}": set(g.sample(range(80), min(80, int(2 + g.expovariate(0.15))))) for k in range(40)}
    sizes = [len(b) for b in blocks.values()]
    ratio = lambda n: sum(k * (k - 1) // 2 for k in sizes if k <= n) / sum(k for k in sizes if k <= n)
    distinct = sorted(set(sizes))
    limit = next((b for a, b in reversed(list(zip(distinct, distinct[1:]))) if ratio(b) < 1.025 * ratio(a)), distinct[0])
    df = spark.createDataFrame([(i, t) for t, b in blocks.items() for i in b], "id long, token string")
    assert pairs.purge_limit(df) == limit


def test_u_takes_the_operators_pairs(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, 2, "a", 3.0)], "c_custkey long, c_nationkey int, c_mktsegment string, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    asked, real = [], score.estimate_u
    monkeypatch.setattr(score, "estimate_u", lambda records, record_id, plan, max_pairs: asked.append(max_pairs) or real(records, record_id, plan, max_pairs))
    queries.queries()["fellegi_sunter_em_customer"](spark, str(tmp_path))
    assert asked == [1_000_000]
