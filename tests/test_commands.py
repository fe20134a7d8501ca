"""Commands: pair files, the candidate selector, tables of results."""

import json

from kindred import commands


def test_export(spark, tmp_path):
    lines = ["entity,name,city"] + [f"{i // 2},person {i // 2}{' jr' if i % 2 else ''},{'north' if i % 4 < 2 else ''}" for i in range(20)]
    (tmp_path / "d.csv").write_text("\n".join(lines))
    entry = {"kind": "real", "description": "d", "file": "d.csv", "entity_id_column": "entity", "field_types": {"name": "text", "city": "categorical"}}
    (tmp_path / "m.json").write_text(json.dumps({"d": entry}))
    out = tmp_path / "out"
    commands.main(["export", str(tmp_path / "m.json"), "--train-pairs", "20", "--valid-pairs", "5", "--test-pairs", "6", "--out", str(out)])
    (text,) = [r["value"] for r in spark.read.text(str(out / "d" / "metadata")).collect()]
    meta = json.loads(text)
    assert (meta["n_records"], meta["n_entities"], meta["n_pairs"], meta["n_positive_pairs"], meta["n_negative_pairs"]) == (20, 10, 190, 10, 180)
    assert meta["splits"] == {"train": {"n_pairs": 20, "n_positive_pairs": 6, "n_negative_pairs": 14}, "valid": {"n_pairs": 5, "n_positive_pairs": 2, "n_negative_pairs": 3}, "test": {"n_pairs": 6, "n_positive_pairs": 2, "n_negative_pairs": 4}}
    records = {int(r["record_index"]): r for r in spark.read.option("header", True).csv(str(out / "d" / "records")).collect()}
    assert len(records) == 20 and records[0]["serialized"].startswith("COL name VAL person 0")
    assert sorted(r["value"].strip() for r in spark.read.text(str(out / "d" / "train_no_label")).collect()) == sorted(r["serialized"].strip() for r in records.values())
    assert spark.read.text(str(out / "d" / "tableB")).count() == 20
    seen = set()
    for split in ("train", "valid", "test"):
        ids = spark.read.option("header", True).csv(str(out / "d" / f"{split}_pairs")).collect()
        lines = spark.read.option("sep", "\t").option("quote", "").csv(str(out / "d" / split)).collect()
        assert len(ids) == len(lines) == meta["splits"][split]["n_pairs"]
        own = {(int(r["left_index"]), int(r["right_index"])) for r in ids}
        assert not own & seen and all((records[int(r["left_index"])]["entity_id"] == records[int(r["right_index"])]["entity_id"]) == (r["label"] == "1") for r in ids)
        seen |= own
        by = {(records[a]["serialized"].strip(), records[b]["serialized"].strip()) for a, b in own}
        assert {(r[0].strip(), r[1].strip()) for r in lines} == by
    assert spark.read.option("header", True).csv(str(out / "d" / "all_pairs_pairs")).count() == 190


def test_selector_goes_on_where_it_ended(spark, tmp_path):
    names = ["red apple pie", "green pear tart", "blue plum cake", "black cherry jam", "white fig roll"]
    (tmp_path / "l.csv").write_text("id,name,note\n" + "".join(f'{i}.0,{n},"x\n{i}"\n' for i, n in enumerate(names)))
    (tmp_path / "r.csv").write_text("rid,title,extra\n" + "".join(f"r{i},{n} fresh,{names[-1 - i]}\n" for i, n in enumerate(names)))
    (tmp_path / "m.csv").write_text("a,b\n" + "".join(f"{i},r{i}\n" for i in range(4)))
    config = {"left": "l.csv", "right": "r.csv", "matches": "m.csv", "left_id": "id", "right_id": "rid", "left_match": "a", "right_match": "b", "short_fields": {"left": ["name"], "right": ["title"]}}
    (tmp_path / "sets.json").write_text(json.dumps({"food": config}))
    asked = []
    out = str(tmp_path / "out")
    run = lambda *more: commands.main(["select", str(tmp_path / "sets.json"), "--dataset", "food", "--top-k", "2", "--field-mode", "short", "--output", out, *more])
    run("--offset", "1", "--limit", "2")
    first = spark.read.json(out).collect()
    assert sorted((r["row_index"], r["left_id"], r["predicted_id"], r["correct"]) for r in first) == [(1, "1", "r1", True), (2, "2", "r2", True)]
    run()
    run()
    rows = spark.read.json(out).collect()
    assert sorted(r["row_index"] for r in rows) == list(range(5)) and {r["dataset"] for r in rows} == {"food"}
    row = commands.select_candidates(spark, "food", config, out, 2, "short", answer=lambda p: asked.append(p) or "[1]", root=str(tmp_path)).first()
    assert not asked and (row["n"], row["precision"], row["recall"]) == (5, 0.8, 1.0)


def test_tables_of_several_results(spark, tmp_path):
    entry = lambda d: {"kind": "real", "description": d, "file": "x.csv", "entity_id_column": "e", "field_types": {"a": "text", "b": "date"}}
    (tmp_path / "m.json").write_text(json.dumps({"one": entry("first"), "two": entry("second")}))
    (tmp_path / "a.csv").write_text("benchmark,baseline,policy,n_records,pr_auc\none,fs,rules,10,0.5\n")
    (tmp_path / "b.csv").write_text("name,scorer,n_records,pr_auc,extra\ntwo,jaccard,4,0.25,z\n")
    (tmp_path / "old.csv").write_text("benchmark,pr_auc\nzero,0.1\n")
    commands.main(["table", str(tmp_path / "m.json"), str(tmp_path / "a.csv"), str(tmp_path / "b.csv"), "--existing", str(tmp_path / "old.csv"), "--out", str(tmp_path / "t")])
    rows = {r["benchmark"]: r for r in spark.read.option("header", True).csv(str(tmp_path / "t")).collect()}
    assert rows.keys() == {"zero", "one", "two"} and (rows["one"]["n_pairs"], rows["one"]["model"], rows["one"]["description"]) == ("45", "fs:rules", "first")
    assert (rows["two"]["n_pairs"], rows["two"]["extra"], rows["two"]["n_fields"], rows["zero"]["pr_auc"]) == ("6", "z", "2", "0.1")
