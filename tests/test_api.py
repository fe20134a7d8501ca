import json

import pytest

import kindred
import kindred.queries
from kindred import cli
from kindred.operators import neural, runs, score


@pytest.fixture
def people(spark):
    return spark.createDataFrame([("r0", "Ada", "Lovelace", "ada@x.org"), ("r1", "A.", "Lovelace", "ada@x.org"), ("r2", "Grace", "Hopper", "grace@x.org")], "id string, first_name string, last_name string, email string")


def test_scores_of_a_table(people, tmp_path):
    neural.RecordTransformer.random().save(str(tmp_path / "m.npz"))
    linker = kindred.load_model(str(tmp_path / "m.npz"))
    out = linker.predict_proba(people, "id").collect()
    assert len(out) == 3 and all(0 <= r["score"] <= 1 for r in out)
    listed = linker.predict_proba(people, "id", ["text", "text", "email"]).collect()
    assert sorted(map(tuple, listed)) == sorted(map(tuple, out))


def test_clusters_with_a_pair_scorer(people):
    linker = kindred.Linker(score.EvidenceScorer(), 0.6)
    assert {r["id"]: r["cluster"] for r in linker.fit_predict(people, "id").collect()} == {"r0": 0, "r1": 0, "r2": 1}
    assert linker.decision_function(people, "id").filter("logit > 0").count() == 1


def test_linkage_scores_tables_together(people):
    other = people.toDF("key", "given", "family", "mail")
    columns = {"name": ("first_name", "given"), "email": ("email", "mail")}
    out = kindred.Linker(score.EvidenceScorer()).score_linkage(people, other, "id", "key", columns, k=3)
    assert out.columns == ["left_index", "right_index", "score", "left_name", "right_name", "left_email", "right_email"]
    rows = out.collect()
    assert [(r["left_index"], r["right_index"]) for r in rows] == [("r0", "r0"), ("r1", "r1"), ("r2", "r2")]
    assert runs.is_descending(out, "score", ["left_index"])
    with pytest.raises(ValueError):
        kindred.Linker().score_linkage(people, other, "id", "key", columns, k=0)


def test_failed_runs_are_rows(spark):
    def fail():
        raise RuntimeError("no data")

    row = runs.guarded(spark, "b", fail, ["f1"]).first()
    assert row["status"] == "failed" and row["error"] == "RuntimeError: no data" and row["f1"] != row["f1"]


@pytest.mark.parametrize(("scorer", "policy"), [("jaccard", "tokens"), ("fellegi_sunter", "rules")])
def test_command_line(spark, tmp_path, scorer, policy):
    lines = ["entity,name,city"] + [f"{i // 2},person number{i // 2} {'jr' if i % 2 else 'sr'},{'north' if i % 4 < 2 else 'south'}" for i in range(24)]
    (tmp_path / "d.csv").write_text("\n".join(lines))
    entry = {"kind": "real", "description": "d", "file": "d.csv", "entity_id_column": "entity", "field_types": {"name": "text", "city": "categorical"}}
    (tmp_path / "m.json").write_text(json.dumps({"d": entry}))
    cli.main([str(tmp_path / "m.json"), "--scorer", scorer, "--policy", policy, "--out", str(tmp_path / "out")])
    row = spark.read.option("header", True).csv(str(tmp_path / "out")).first()
    assert row["status"] == "ok", row["error"]
    assert float(row["roc_auc"]) > 0.6


def test_command_line_across_sources(spark, tmp_path):
    lines = ["entity,name,source_table"] + [f"{i // 2},person number{i // 2},{'A' if i % 2 else 'B'}" for i in range(12)]
    (tmp_path / "d.csv").write_text("\n".join(lines))
    entry = {"kind": "linkage", "description": "d", "file": "d.csv", "entity_id_column": "entity", "field_types": {"name": "text"}, "ignored_columns": ["source_table"]}
    (tmp_path / "m.json").write_text(json.dumps({"first": entry, "second": entry, "third": entry}))
    for policy in ("all", "tokens"):
        cli.main([str(tmp_path / "m.json"), "--policy", policy, "--pair-scope", "cross_source", "--no-purging", "--no-pruning", "--offset", "1", "--limit", "1", "--out", str(tmp_path / policy)])
        (row,) = spark.read.option("header", True).csv(str(tmp_path / policy)).collect()
        assert (row["name"], row["status"], row["pair_scope"]) == ("second", "ok", "cross_source"), row["error"]
        assert float(row["candidate_pairs"]) == 36


def _scoped(spark, tmp_path, lines, entry, *more):
    (tmp_path / "d.csv").write_text("\n".join(lines))
    (tmp_path / "m.json").write_text(json.dumps({"d": {"kind": "linkage", "description": "d", "file": "d.csv", "entity_id_column": "entity", "field_types": {"name": "text"}} | entry}))
    cli.main([str(tmp_path / "m.json"), "--policy", "rules", "--out", str(tmp_path / "out"), *more])
    (row,) = spark.read.option("header", True).csv(str(tmp_path / "out")).collect()
    assert row["status"] == "ok", row["error"]
    return row


def test_metrics_across_sources_leave_other_pairs_out(spark, tmp_path):
    """Three records of A and two of B: six pairs across, three of them true, two of those found by their names."""
    lines = ["entity,name,source_table", "x,red one,A", "x,red one,A", "y,blue,A", "x,red one,B", "y,green,B"]
    row = _scoped(spark, tmp_path, lines, {"ignored_columns": ["source_table"]}, "--pair-scope", "cross_source")
    wanted = {"prevalence": 0.5, "pair_recall": 2 / 3, "pair_precision": 1, "candidate_pairs": 2, "candidate_fraction": 1 / 3, "true_pair_candidate_recall": 2 / 3}
    assert {k: float(row[k]) for k in wanted} == pytest.approx(wanted)
    # scores 1, 1, 0, 0, 0, 0 of targets 1, 1, 1, 0, 0, 0
    assert float(row["roc_auc"]) == pytest.approx((2 * 3 + 1 * 3 / 2) / 9)
    assert float(row["pr_auc"]) == pytest.approx(2 / 3 + 1 / 3 * 0.5)


def test_metrics_of_paired_rows(spark, tmp_path):
    lines = ["entity,name,pair_id,source_table,match_label"]
    lines += ["a,one,1,profile1,True", "a,one,1,profile2,True", "b,two,2,profile1,false", "c,two,2,profile2,false", "d,x,3,profile1,true", "d,y,3,profile2,true", "e,p,4,profile1,False", "e,q,4,profile2,False"]
    lines += ["f,one,5,profile1,true", "g,one,6,profile1,true", "g,one,6,profile1,true"]  # no pairs
    row = _scoped(spark, tmp_path, lines, {"pair_scope": "paired_rows"})
    wanted = {"prevalence": 0.5, "pair_recall": 0.5, "pair_precision": 0.5, "candidate_pairs": 2, "candidate_fraction": 0.5, "true_pair_candidate_recall": 0.5}
    assert {k: float(row[k]) for k in wanted} == pytest.approx(wanted)
    assert row["pair_scope"] == "paired_rows"


def test_entry_adds_corpus_queries_only_where_they_are(monkeypatch):
    import importlib

    import __spark_entry__ as entry

    def absent(name):
        raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    monkeypatch.setattr(importlib, "import_module", absent)
    assert set(entry.queries()) == set(kindred.queries.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    monkeypatch.setattr(importlib, "import_module", lambda name: absent("numpy"))
    with pytest.raises(ModuleNotFoundError, match="numpy"):
        entry.queries()
