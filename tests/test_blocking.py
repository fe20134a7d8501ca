"""Blocks with hot keys, pair budgets, priors from counts, estimates from samples, encodings, lookups."""

import itertools
import random
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred import storage
from kindred.functions import compare as C
from kindred.functions import text as X
from kindred.operators import metrics, neural, pairs, score, views
from kindred.plans import synth, worldgraph
from kindred.sources import catalog, lookups, selector


@pytest.fixture
def records(spark):
    g = random.Random(1)
    rows = [(i, "hot" if i % 3 else g.choice(["a", "b", "", None]), g.choice(["x", "y", "z", None]), g.randrange(4)) for i in range(120)]
    return rows, spark.createDataFrame(rows, "id long, first string, second string, third int")


def agree(a, b, *columns):
    return any(a[c] not in (None, "") and a[c] == b[c] for c in columns)


@pytest.mark.parametrize("heavy", [5_000, 7])
def test_blocks_with_a_hot_key(records, rows, monkeypatch, heavy):
    data, df = records
    monkeypatch.setattr(pairs, "HEAVY", heavy)
    found = pairs.blocked_pairs(df, "id", ["first", "second"])
    wanted = [(a[0], b[0], "exact:first" if agree(a, b, 1) else "exact:second") for a, b in itertools.combinations(data, 2) if agree(a, b, 1, 2)]
    assert rows(found, "left_id", "right_id", "match_key") == sorted(wanted, key=repr)
    scored = views.score_linkage(df, df, lambda _: F.lit(1.0), "id", "id", {"first": ("first", "first")}, 10**6, block_on=["first"])
    assert scored.count() == sum(a[1] is not None and a[1] == b[1] for a in data for b in data)


def test_token_blocks_and_neighbours_with_a_hot_key(spark, rows, monkeypatch):
    texts = [(i, f"common word{i % 5} own{i}") for i in range(40)]
    df = spark.createDataFrame(texts, "id long, text string")
    plain = rows(pairs.block_pairs(pairs.token_blocks(df, "id", ["text"])))
    near = rows(pairs.tfidf_neighbours(df, df, "id", "text", "id", "text", 3).withColumn("score", F.round("score", 9)))
    monkeypatch.setattr(pairs, "HEAVY", 3)
    assert rows(pairs.block_pairs(pairs.token_blocks(df, "id", ["text"]))) == plain
    assert {(a, b): w for a, b, w in plain} == {(a, b): 1 + (a % 5 == b % 5) for a, b in itertools.combinations(range(40), 2)}
    assert rows(pairs.tfidf_neighbours(df, df, "id", "text", "id", "text", 3).withColumn("score", F.round("score", 9))) == near


def test_too_many_pairs_are_an_error(records):
    _, df = records
    with pytest.raises(ValueError, match="over the limit"):
        pairs.blocked_pairs(df, "id", ["first"], most=100)
    with pytest.raises(ValueError, match="no blocking rules"):
        pairs.blocked_pairs(df, "id", [])


def test_pairs_of_rules_are_counted_without_making_them(records):
    data, df = records
    n = sum(agree(a, b, 1, 2, 3) for a, b in itertools.combinations(data, 2))
    assert pairs.rule_pair_count(df, ["first", "second", "third"]) == n
    assert score.estimate_prior(df, ["first", "second", "third"], 0.7) == pytest.approx(min(n / 0.7 / (120 * 119 / 2), 0.5))


def test_sampled_blocks_are_within_the_budget(records):
    data, df = records
    every = {(a[0], b[0]) for a, b in itertools.combinations(data, 2) if agree(a, b, 1)}
    whole = pairs.sampled_block_pairs(df, "id", "first", ["third"], 10**6)
    assert {(r["left_id"], r["right_id"]) for r in whole.collect()} == every
    some = [(r["left_id"], r["right_id"]) for r in pairs.sampled_block_pairs(df, "id", "first", ["third"], 500).collect()]
    assert set(some) < every and len(set(some)) == len(some) and 100 < len(some) < 1000


def test_em_against_plain_python(spark):
    """Counts by vector of levels, then expectation and maximisation, pair by pair."""
    g = random.Random(2)
    plan = {"a": ("exact", ()), "b": ("exact", ())}
    vectors = [(1, 1)] * 30 + [(1, 0)] * 10 + [(0, 1)] * 12 + [(0, 0)] * 200 + [(None, 1)] * 5
    g.shuffle(vectors)
    df = spark.createDataFrame(vectors, "gamma_a int, gamma_b int")
    u = {"a": [0.8, 0.2], "b": [0.7, 0.3]}
    model = score.expectation_maximisation(df, plan, u, 0.05, rounds=4, tolerance=0)
    m, share = {"a": [0.1, 0.9], "b": [0.1, 0.9]}, 0.05
    for _ in range(4):
        p = []
        for v in vectors:
            odds = share / (1 - share)
            for c, x in zip("ab", v):
                odds *= 1 if x is None else m[c][x] / u[c][x]
            p.append(odds / (1 + odds))
        for k, c in enumerate("ab"):
            w = [sum(q for q, v in zip(p, vectors) if v[k] == x) + 1e-6 for x in (0, 1)]
            m[c] = [x / sum(w) for x in w]
        share = sum(p) / len(p)
    assert model.history[-1] == pytest.approx(share) and all(model.m[c] == pytest.approx(m[c]) for c in "ab")


def test_splits_beyond_three_get_negatives(spark):
    df = spark.createDataFrame([(i, i + 100, int(i < 20)) for i in range(100)], "left_id long, right_id long, label int")
    out = pairs.split_pairs(df, {"train": 20, "valid": 8, "test": 8, "more": 5, "rest": 1000})
    counts = {r["split"]: (r["positives"], r["negatives"]) for r in metrics.split_counts(out).collect()}
    assert counts == {"train": (12, 8), "valid": (4, 4), "test": (4, 4), "more": (0, 5), "rest": (0, 59)}
    assert out.select("left_id").distinct().count() == out.count() == 100


def test_jaro_winkler_of_repeated_values(spark):
    df = spark.createDataFrame([("martha", "marhta"), ("dwayne", "duane"), ("martha", "marhta"), (None, "x"), ("", ""), ("same", "same")] * 3, "a string, b string")
    found = [r["s"] for r in df.select(F.round(C.jaro_winkler()("a", "b"), 6).alias("s")).collect()]
    assert found == [0.961111, 0.84, 0.961111, None, 0.0, 1.0] * 3


def test_jaro_winkler_of_many_pairs_at_once():
    g = random.Random(3)
    word = lambda n: "".join(g.choice("abcdé漢\U0001f600 ") for _ in range(n))
    texts = [word(g.choice([0, 1, 2, 5, 8, 9, 20, 40, 64, 65, 90])) for _ in range(300)]
    pairs_ = [(g.choice(texts), g.choice(texts)) for _ in range(3000)] + [(t, t) for t in texts] + [(t, t[:-1] + "x" + t[-1:]) for t in texts]
    assert C.jaro_winkler_texts(pairs_) == pytest.approx([C.jaro_winkler_text(*p) for p in pairs_], abs=1e-12)
    assert C.jaro_winkler_texts([]) == []


def test_encoding_is_told_by_the_whole_file(spark, tmp_path):
    """A Latin-1 byte after the first megabyte is read as such; a valid file with a mark, or cut anywhere, stays UTF-8."""
    plain = "id,name\n" + "".join(f"{i},{'x' * 90}\n" for i in range(15_000))
    (tmp_path / "late.csv").write_bytes(plain.encode() + "99999,é\n".encode("latin-1"))
    (tmp_path / "utf.csv").write_bytes(b"\xef\xbb\xbf" + plain.encode() + "99999,é\ufffd\n".encode())
    for name, wanted in (("late.csv", "é"), ("utf.csv", "é\ufffd")):
        df = catalog.read_text_csv(spark, str(tmp_path / name))
        assert df.columns == ["id", "name"] and df.filter("id = '99999'").first()["name"] == wanted


def test_selector_counts_tokens(spark):
    prompts = spark.createDataFrame([(1, [5], "a b c"), (2, [6], "fail"), (3, [7], "d")], "left_id long, candidate_ids array<long>, prompt string")

    def answer(prompt):
        if prompt == "fail":
            raise OSError("away")
        return selector.Answer("[1]", len(prompt.split()), 2) if prompt != "d" else "[0]"

    chosen = selector.ask(prompts, answer, wait=0.0)
    assert [(r["answer"], r["prompt_tokens"], r["completion_tokens"], r["error"]) for r in chosen.orderBy("left_id").collect()] == [("[1]", 3, 2, None), (None, 0, 0, "OSError: away"), ("[0]", 0, 0, None)]
    judged = selector.judge_selection(selector.select(prompts), spark.createDataFrame([(1, 5)], "left_id long, right_id long"))
    row = metrics.selector_metrics(judged).first()
    assert row["prompt_tokens"] == 5 and row["completion_tokens"] == 3


# -- worlds ----------------------------------------------------------------------------------------------------------


def test_fields_follow_affinities():
    draw = lambda **o: [worldgraph.sample_fields(4, seed, candidates=("a", "b", "c", "d", "e"), base={"a": 9.0}, **o) for seed in range(200)]
    near = draw(affinities={("a", "b"): 50.0, ("c", "b"): 50.0})
    assert all({"a", "b", "c"} <= set(x) for x in near)
    repeated = [worldgraph.sample_fields(3, s, candidates=("a", "b"), base={"a": 9.0}, affinities={}, most={"a": 3}, repeat_penalty=-50.0) for s in range(50)]
    assert all(sorted(x) == ["a", "a", "b"] for x in repeated)
    # two repeats of a count 1 + decay of its affinity: enough for b against a base of 1.2 only without decay's damping
    last = [worldgraph.sample_fields(3, s, 0.001, ("a", "b", "c"), {"a": 2}, 0.0, decay, {"a": 9.0, "c": 1.2}, {("a", "b"): 0.8}) for decay in (0.1, 0.9) for s in range(5)]
    assert all("c" in x for x in last[:5]) and all("b" in x for x in last[5:])
    for bad in ({"n": 0}, {"n": 99}, {"n": 2, "temperature": 0}, {"n": 2, "decay": 2}):
        with pytest.raises(ValueError):
            worldgraph.sample_fields(**{"seed": 1, **bad})


def test_column_names_of_repeats():
    assert worldgraph.column_names(["a", "b", "a", "a"]) == ["a", "b", "a_2", "a_3"]


def test_service_rules_are_off_unless_allowed(spark):
    asked = []

    def answer(prompt):
        asked.append(prompt)
        if "Zoe" in prompt:
            return "not json"
        return '{"username": "user-x"}'

    rule = worldgraph.service_rule("username", ("first_name",), answer, weight=1e9)
    rules = (*worldgraph.RULES, rule)
    nodes = worldgraph.ancestors(["username", "last_name"])
    assert worldgraph.choose_rules(nodes, 3, rules)["username"].name != "service"
    chosen = worldgraph.choose_rules(nodes, 3, rules, services=True)
    assert chosen["username"].name == "service"
    people = synth.entities(spark, 200, ["username", "first_name", "last_name"], 3, chosen).collect()
    assert all(r["username"] == (None if r["first_name"] == "Zoe" else "user-x") for r in people) and any(r["first_name"] == "Zoe" for r in people)


def test_bios_come_from_their_pools(spark):
    for rule in (r for r in worldgraph.RULES if r.node == "account_bio"):
        nodes = worldgraph.ancestors([*rule.inputs, "account_bio"])
        rules = worldgraph.choose_rules(nodes, 1) | {"account_bio": rule}
        found = [r["account_bio"] for r in synth.entities(spark, 300, list(nodes), 1, rules).collect()]
        assert len(set(found)) > 50 and not any("{" in x or not x for x in found)


def test_targets_have_the_rate_and_bases_are_none(spark):
    fields = ["first_name", "last_name", "city", "phone", "email_address", "date_of_birth"]
    rules = worldgraph.choose_rules(worldgraph.ancestors(fields), 5)
    for rate in (0.25, 1.0):
        out = {r["entity"]: r for r in synth.add_hard_negatives(synth.entities(spark, 2000, fields, 5, rules), rate, 5, rules).collect()}
        targets = [r for r in out.values() if r["base"] is not None]
        assert len(out) == 2000 and all(out[r["base"]]["base"] is None and r["base"] // 16 == r["entity"] // 16 for r in targets)
        assert abs(len(targets) / 2000 - min(rate, 15 / 16)) < 0.03
        assert len({r["entity"] % 16 for r in targets}) == 16


def test_corruptions_change_the_value(spark):
    df = spark.range(3000).select(F.xxhash64("id").alias("s"), F.lit("Ann-Marie O'Neill 42").alias("v"))
    out = [r["c"] for r in df.select(synth.corrupt(F.col("v"), "s", "x").alias("c")).collect()]
    assert sum(x == "Ann-Marie O'Neill 42" for x in out) < 0.03 * len(out) and len(set(out)) > 150


def test_worlds_are_drawn_in_parallel(spark):
    worlds = synth.generate_worlds(spark, 3, seed=4, records=(20, 30), fields=(3, 5))
    again = synth.generate_worlds(spark, 3, seed=4, records=(20, 30), fields=(3, 5))
    for a, b in zip(worlds, again):
        found = a.records.orderBy("record_id").collect()
        assert found == b.records.orderBy("record_id").collect()
        assert 20 <= len(found) <= 30 and [r["record_id"] for r in found] == list(range(len(found))) and 3 <= len(a.field_types) <= 5


def test_phones_have_their_states_codes(spark):
    raw = spark.createDataFrame([("217", "IL"), ("309", "IL"), ("503", "OR"), ("99", "TX")], "`Area Code` string, Region string")
    rules = worldgraph.rules_with_area_codes(lookups.area_codes(raw))
    nodes = worldgraph.ancestors(["phone", "state"])
    chosen = {r.node: r for r in rules if r.node in nodes} | {"phone": next(r for r in rules if r.node == "phone" and r.inputs == ("state",))}
    for r in synth.entities(spark, 300, list(nodes), 2, chosen).collect():
        code = "".join(c for c in r["phone"].removeprefix("+1") if c.isdigit())[:3]
        assert code in {"IL": ("217", "309"), "OR": ("503",)}.get(r["state"], ("217", "309", "503"))


# -- values and neural parts -------------------------------------------------------------------------------------------


def test_names_fold_as_unicode_does(spark):
    texts = ["Žižek", "Łódź", "Ñandú", "ﬁne", "Ǻ", "ḁẗ", "İstanbul", "Æsir", "Straße", "Ĳssel", "x²", "漢字 a", "ﬀ", "Ⅳ", "ŉ", "Ｗide"]
    fold = lambda t: unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode()
    found = [r["f"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.ascii_fold("t").alias("f")).collect()]
    assert found == [fold(t) for t in texts]


def test_company_domains(spark):
    df = spark.range(200).select(F.xxhash64("id").alias("s"), F.lit("The Blue & Field Foods, Inc.").alias("c"))
    stems = {r["d"].rpartition(".")[0] for r in df.select(X.company_domain("c", "s").alias("d")).collect()}
    assert stems == {"blue-field-foods", "bluefieldfoods", "blue"}


def test_hashed_ngrams_against_plain_python(spark):
    texts = ["Ann Lee", "", "a", None, "aaaa aaaa"]
    found = [r["v"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.hashed_ngrams("t", 16).alias("v")).collect()]
    for t, v in zip(texts, found):
        if t is None:
            assert v is None
            continue
        full, counts = f" {t.lower()} ", [0.0] * 16
        for i in range(max(len(full) - 2, 1)):
            counts[zlib.crc32(full[i : i + 3].encode()) % 16] += 1
        norm = sum(x * x for x in counts) ** 0.5
        assert v == pytest.approx([x / norm for x in counts])


def test_slots_attend_to_records():
    model = neural.RecordTransformer.random(neural.TransformerConfig(decoder="slot_pair_mlp", slots=5), seed=1)
    r = np.random.default_rng(0).normal(size=(7, 32))
    share, context = model.mix(r)
    assert share.shape == (7, 5) and np.allclose(share.sum(1), 1) and context.shape == (7, 32)
    order = np.random.default_rng(1).permutation(7)
    again, _ = model.mix(r[order])
    assert np.allclose(again, share[order])  # slots don't depend on the records' order
    w, slots, h, d = model.weights, model.weights["slots"], 4, 8
    for i in range(2):
        q, k, v = (x @ w[f"slot.{i}.{p}.w"] + w[f"slot.{i}.{p}.b"] for p, x in zip("qkv", (slots, r, r)))
        heads = [neural.softmax(q[:, j * d : j * d + d] @ k[:, j * d : j * d + d].T / d**0.5) @ v[:, j * d : j * d + d] for j in range(h)]
        slots = neural.layer_norm(slots + np.concatenate(heads, 1) @ w[f"slot.{i}.o.w"] + w[f"slot.{i}.o.b"], 1, 0)
    assert np.allclose(share, neural.softmax(r @ slots.T))


def test_attention_in_slices(monkeypatch):
    model = neural.RecordTransformer.random(seed=2)
    x = np.random.default_rng(0).normal(size=(3, 9, 32))
    whole = model._attend("0.record", x)
    monkeypatch.setattr(neural, "ATTENTION", 250)
    assert np.allclose(model._attend("0.record", x), whole)


def test_shared_tables_go(spark):
    df = storage.written(spark.range(5).toDF("x"), "some")
    path = df.inputFiles()[0].rpartition("/")[0]
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = lambda: hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    assert there() and df.count() == 5
    storage.drop_tables(df)
    assert not there()


@pytest.mark.parametrize("heavy", [3, 1000])
def test_joins_deal_both_sides(spark, heavy):
    left = spark.createDataFrame([("hot", i) for i in range(10)] + [("one", 50), (None, 51)], "k string, a long")
    right = spark.createDataFrame([("hot", i) for i in range(100, 140)] + [("one", i) for i in range(200, 230)] + [(None, 1), ("none", 2)], "k string, b long")
    found = pairs.dealt_join(left, right, ["k"], "a", heavy)
    assert found.count() == 400 + 30 and found.distinct().count() == 430 and found.columns == ["k", "a", "b"]


def test_pairs_of_blocks_are_rows_once(spark):
    g = random.Random(5)
    own = {i: {g.choice("abcdefgh") for _ in range(4)} for i in range(30)}
    blocks = spark.createDataFrame([(t, i) for i, x in own.items() for t in x], "token string, id long")
    found = {(r["left_id"], r["right_id"]): r["weight"] for r in pairs.block_pairs(blocks).collect()}
    assert found == {(a, b): len(own[a] & own[b]) for a, b in itertools.combinations(own, 2) if own[a] & own[b]}
    assert pairs.block_pairs(blocks).count() == len(found)


def test_counts_of_levels_without_pairs(spark):
    g = random.Random(11)
    names = ["martha", "marhta", "marta", "dwayne", "duane", "dixon", "dicksonx", "", None]
    mails = ["a@x.org", "a@y.org", "b@x.org", "A@X.org", None]
    data = [(i, g.choice(["p", "q", None, ""]), g.choice(names), g.choice(["u", "v", None]), g.choice([1, 2, 3, None]), g.choice(mails), g.choice(["2001-02-03", "2001-02-04", "1999-12-31", None])) for i in range(140)]
    df = spark.createDataFrame(data, "id long, rule string, name string, kind string, num int, mail string, born string")
    plan = C.comparison_plan({"rule": "identifier", "name": "text", "kind": "categorical", "num": "numeric", "mail": "email", "born": "date"})
    columns = [c for c in plan if c != "rule"]
    pairs_ = score.add_gammas(pairs.blocked_pairs(df, "id", ["rule"], columns), {c: plan[c] for c in columns})
    wanted = {tuple(r[f"gamma_{c}"] for c in columns): r["n"] for r in score.gamma_counts(pairs_, columns).collect()}
    found = {tuple(r[f"gamma_{c}"] for c in columns): r["n"] for r in score.block_level_counts(df, "id", "rule", plan)}
    assert found == wanted and len(wanted) > 50
    assert score.block_level_counts(df.limit(0), "id", "rule", plan) == []


def test_levels_are_counted_by_classes_of_equal_records(spark, monkeypatch):
    """600 records of six classes: no join has more rows of a side than values of classes ask for."""
    df = spark.createDataFrame([(i, "p", ["martha", "marhta", "dixon"][i % 3], i % 2) for i in range(600)], "id long, rule string, name string, num int")
    plan = C.comparison_plan({"rule": "identifier", "name": "text", "num": "numeric"})
    whole, sizes = pairs.dealt_join, []
    monkeypatch.setattr(pairs, "dealt_join", lambda a, b, *more, **some: sizes.append(max(a.count(), b.count())) or whole(a, b, *more, **some))
    found = score.block_level_counts(df, "id", "rule", plan)
    assert sum(r["n"] for r in found) == 600 * 599 // 2 and max(sizes) < 60


def _closeness(names):
    return F.round(1 / (1 + F.abs(F.col("left_x") - F.col("right_x"))), 2)


@pytest.mark.parametrize("block_on", [["g"], ["h", "g"], []])
@pytest.mark.parametrize("wide", [1.0, 300.0])
def test_linkage_meets_only_near_rows(spark, monkeypatch, block_on, wide):
    """The same best pairs, ties of rounded scores and rows without a value included; few rows meet."""
    g = random.Random(int(wide))
    row = lambda i: (i, g.choice(["p", "q", None]), g.randint(0, 3), g.choice([None, float("nan"), float("inf"), *[round(g.uniform(-wide, wide), 2) for _ in range(30)]]))
    left, right = (spark.createDataFrame([row(i) for i in range(n)], "id long, g string, h long, x double") for n in (300, 200))
    met, whole = [], views.dealt_join
    monkeypatch.setattr(views, "dealt_join", lambda *a: met.append(whole(*a)) or met[-1])
    of = lambda near: [(r["left_index"], r["right_index"], r["score"]) for r in views.score_linkage(left, right, _closeness, "id", "id", ["g", "h", "x"], 20, block_on, near=near).collect()]
    near = views.Near("x", lambda s: 1 / (s - 0.0051) - 1 if s > 0.01 else float("inf"))
    found = of(near)
    count = sum(m.count() for m in met)
    assert len(found) == 20 and found == of(None)
    assert count < 60_000 / 10 or wide == 1.0
    none = views.Near("x", lambda s: float("inf"))
    assert of(none) == found
