import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import graph, metrics, neural, pairs, runs
from kindred.plans import synth, worldgraph
from kindred.sources import catalog, convert, lookups, selector, sinks
from kindred.streaming import incremental


def test_graph():
    assert worldgraph.ancestors(["phone"]) == {"phone", "city", "state", "location"}
    assert worldgraph.descendants(["location"], ["city"]) == {"street_address", "postal_code", "state", "country", "account_bio", "phone"}
    order = worldgraph.topological_order(worldgraph.NODES)
    assert all(order.index(a) < order.index(b) for a, b in worldgraph.EDGES)
    with pytest.raises(ValueError, match="cycle"):
        worldgraph.topological_order("ab", [("a", "b"), ("b", "a")])


def test_process_matches_at_its_rate():
    ids = synth.sample_entity_ids(2000, 0.05, 1)
    _, n = np.unique(ids, return_counts=True)
    assert 0.005 < (n * (n - 1)).sum() / (2000 * 1999) < 0.3
    assert ids[0] == 0 and (np.diff(np.maximum.accumulate(ids)) <= 1).all()


def test_world_is_the_same_for_a_seed(spark):
    one = synth.generate_world(spark, 24, 6, 1337)
    assert one.records.count() == 24 and len(one.field_types) == 6
    again = synth.generate_world(spark, 24, 6, 1337)
    key = lambda w: sorted(map(repr, w.records.collect()))
    assert key(one) == key(again) != key(synth.generate_world(spark, 24, 6, 1338, fields=list(one.field_types)))


def test_hard_negatives_keep_and_change(spark):
    fields = ["first_name", "last_name", "city", "phone", "date_of_birth"]
    rules = worldgraph.choose_rules(worldgraph.ancestors(fields), 1)
    base = synth.entities(spark, 400, fields, 1, rules)
    out = {r["entity"]: r for r in synth.add_hard_negatives(base, 0.5, 1, rules).collect()}
    marked = [r for r in out.values() if r["base"] is not None]
    assert 100 < len(marked) < 250 and all(out[r["base"]]["base"] is None for r in marked)
    assert all(r["last_name"] == out[r["base"]]["last_name"] for r in marked)
    assert all(r["date_of_birth"] == out[r["base"]]["date_of_birth"] for r in marked if r["contract"] == "twins")


def test_observation_rates(spark):
    df = spark.range(2000).select("id", F.lit("Elizabeth").alias("first_name"))
    names = spark.createDataFrame([("elizabeth", ["liz"])], "name string, aliases array<string>")
    out = synth.observe(df, ["id"], {"first_name": "text"}, synth.Observation(0.2, 0.3, 0.5), 1, names)
    n = {r["first_name"]: r["count"] for r in out.groupBy("first_name").count().collect()}
    assert 300 < n[None] < 500 and n["Liz"] > 150 and len(n) > 50


def test_catalog(spark, tmp_path):
    (tmp_path / "people.csv").write_text("﻿cluster,name,source_table,extra\n1,Zoë,A,x\n1,Zoe,B,x\n2,Bob,A,y\n", encoding="utf-8")
    entry = {"kind": "real", "description": "d", "file": "people.csv", "entity_id_column": "cluster", "field_types": {"name": "text"}, "ignored_columns": ["source_table", "extra"]}
    (tmp_path / "m.json").write_text(json.dumps({"_schema": {}, "people": entry}))
    c = catalog.Catalog(spark, str(tmp_path / "m.json"))
    b = c.load("people")
    assert sorted(tuple(r) for r in b.records.collect()) == [("1", "Zoe", "B"), ("1", "Zoë", "A"), ("2", "Bob", "A")]
    assert c.metadata().first()["field_summary"] == "name:text"
    with pytest.raises(ValueError, match="unknown field types"):
        catalog.validate_config("x", entry | {"field_types": {"name": "colour"}})
    with pytest.raises(ValueError, match="n_entities"):
        catalog.validate_config("x", entry | {"entity_sample": {"n_entities": True, "seed": 1, "require_positive_pairs": True, "require_variation": False}})


def test_latin1_is_recognised(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes("id,name\n1,Zoë\n".encode("latin-1"))
    assert catalog.read_text_csv(spark, str(tmp_path / "l.csv"), ["name"]).first()[0] == "Zoë"


def test_conversion_keeps_singletons(spark):
    a = spark.createDataFrame([("1", "x"), ("2", "y")], "id string, name string")
    b = spark.createDataFrame([("7", "x"), ("8", "z")], "id string, name string")
    m = spark.createDataFrame([("1", "7"), ("404", "7")], "left_id string, right_id string")
    maps = (convert.TableMap("id", {"name": "name"}),) * 2
    out = {(r["source_table"], r["source_id"]): r["entity_id"] for r in convert.convert_linkage(a, b, m, "n", maps).collect()}
    assert out["A", "1"] == out["B", "7"] and len(set(out.values())) == 3


def test_profile_pairs(spark, tmp_path):
    row = {"fullname": "A", "email": ["a", ""], "phone": [], "addr": None, "dob": "1"}
    (tmp_path / "p.jsonl").write_text("\n".join(json.dumps({"match": str(i < 2), "profile1": row, "profile2": row}) for i in range(4)))
    pairs = convert.balanced_pairs(convert.read_profile_pairs(spark, str(tmp_path / "p.jsonl")), 1)
    out = convert.profile_records(pairs).collect()
    assert len(out) == 4 and out[0]["email"] == "a" and len({r["entity_id"] for r in out}) == 3


def test_selector_retries_and_reports(spark):
    def broken(prompt):
        raise OSError("no network")

    df = spark.createDataFrame([("p",)], "prompt string")
    assert selector.ask(df, broken, retries=2, wait=0).first()["error"] == "OSError: no network"
    assert selector.overlap_answer("Given entity record:\nred car\n\nCandidate records:\n[1] blue\n[2] red\n").text == "[2]"


def test_sinks_resume(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(5).withColumnRenamed("id", "k")
    sinks.append_json(df.filter("k < 2"), path)
    left = sinks.remaining(df, path, ["k"], "k long")
    assert sorted(r["k"] for r in left.collect()) == [2, 3, 4]
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        sinks.write_csv(df, path)


@pytest.mark.parametrize("decoder", ["pair_mlp", "pair_difference", "slot_coassignment", "slot_pair_mlp"])
def test_transformer_is_symmetric(decoder):
    import pandas as pd

    table = pd.DataFrame({"n": ["Ada", "A.", None], "d": ["2024-01-01", "soon", None], "x": [1.0, 2.0, None], "c": ["u", "v", "u"]})
    model = neural.RecordTransformer.random(neural.TransformerConfig(decoder=decoder, representer="entity_target"))
    p = model.predict(table, {"n": "text", "d": "date", "x": "numeric", "c": "categorical"})
    assert p.shape == (3, 3) and np.allclose(p, p.T) and ((p >= 0) & (p <= 1)).all()


def test_transformer_file_and_errors(spark, tmp_path):
    model = neural.RecordTransformer.random()
    model.save(str(tmp_path / "m.npz"))
    assert np.array_equal(neural.RecordTransformer.load(str(tmp_path / "m.npz")).weights["slots"], model.weights["slots"])
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "x")], "id int, name string, b string")
    assert neural.score_blocks(df, model, "id", "infer", "b").count() == 3
    with pytest.raises(ValueError, match="infer"):
        neural.score_blocks(df, model, "id", "guess")
    with pytest.raises(ValueError, match="1 field types"):
        neural.score_blocks(df, model, "id", ["text"])
    with pytest.raises(ValueError, match="fit one task"):
        neural.score_blocks(df, model, "id", {"name": "text"}, "b", most=2)


def test_incremental_linkage(spark, tmp_path):
    schema = "id long, key string, v string"
    known, new, links = (str(tmp_path / n) for n in ("known", "new", "links"))
    spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], schema).write.parquet(known)
    spark.createDataFrame([(10, "a", "x"), (11, "a", "z"), (12, "c", "x")], schema).coalesce(1).write.parquet(new)
    stream = spark.readStream.schema(schema).parquet(new)
    same = lambda: (F.col("left_v") == F.col("right_v")).cast("double")
    incremental.start_linkage(stream, known, links, str(tmp_path / "cp"), "key", "id", same).awaitTermination(120)
    assert [(r["left_id"], r["right_id"]) for r in spark.read.parquet(links).collect()] == [(1, 10)]
    assert spark.read.option("recursiveFileLookup", "true").parquet(known).count() == 5


def test_links_within_a_batch_and_repeated_batches(spark, tmp_path):
    schema = "id long, key string, v string"
    same = lambda: (F.col("left_v") == F.col("right_v")).cast("double")
    known = str(tmp_path / "known")
    batch = spark.createDataFrame([(2, "a", "x"), (3, "a", "x"), (3, "a", "x"), (4, None, "x"), (5, None, "x")], schema)
    first = incremental.known_records(spark, batch, known, 0)  # there's no such folder yet
    assert {tuple(r) for r in incremental.link_batch(batch, first, "key", "id", same, 0.5).collect()} == {(2, 3, 1.0)}
    batch.write.parquet(f"{known}/batch-0")  # the batch fails after that, and is run again
    again = incremental.known_records(spark, batch, known, 0)
    assert again.count() == 0 and {tuple(r) for r in incremental.link_batch(batch, again, "key", "id", same, 0.5).collect()} == {(2, 3, 1.0)}
    later = spark.createDataFrame([(1, "a", "x"), (9, "a", "y")], schema)
    found = incremental.link_batch(later, incremental.known_records(spark, later, known, 1), "key", "id", same, 0.5)
    assert {(r["left_id"], r["right_id"]) for r in found.collect()} == {(2, 1), (3, 1)}


def test_stream_keeps_components(spark, tmp_path):
    schema = "id long, key string, v string"
    known, new, links = (str(tmp_path / n) for n in ("known", "new", "links"))
    spark.createDataFrame([(1, "a", "x"), (10, "b", "x"), (11, "b", "x"), (12, "c", "x")], schema).coalesce(1).write.parquet(f"{new}/1")
    store = incremental.ComponentStore(spark, str(tmp_path / "components"))
    same = lambda: (F.col("left_v") == F.col("right_v")).cast("double")

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(new)
        incremental.start_linkage(stream, known, links, str(tmp_path / "cp"), "key", "id", same, components=store).awaitTermination(120)
        return {r["node"]: r["component_id"] for r in store.read().collect()}

    assert run() == {10: 10, 11: 10}
    spark.createDataFrame([(2, "a", "x"), (3, "b", "x")], schema).coalesce(1).write.parquet(f"{new}/2")
    assert run() == {10: 3, 11: 3, 3: 3, 1: 1, 2: 1}


def test_merged_components_equal_whole_ones(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(80), rng.randrange(80), rng.randrange(4)) for _ in range(90)] + [(None, 3, 0), (4, None, 1), (90, 90, 2)]
    links = spark.createDataFrame(edges, "left_id long, right_id long, b int")
    nodes = {x for a, b, _ in edges if a is not None and b is not None for x in (a, b)}
    whole = graph.component_labels(spark.createDataFrame([(n,) for n in nodes], "record_id long"), links)
    merged = incremental.merged_in_batches(links, F.col("b"), 4)
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, whole.collect()))


def test_metadata_with_split_counts(spark, tmp_path):
    labelled = spark.createDataFrame([(i, i + 50, int(i < 10)) for i in range(40)], "left_id long, right_id long, label int")
    split = pairs.split_pairs(labelled, {"train": 12, "valid": 4, "test": 4})
    counts = {r["split"]: {"pairs": r["pairs"], "positives": r["positives"], "negatives": r["negatives"]} for r in metrics.split_counts(split).collect()}
    sinks.write_metadata(spark, str(tmp_path / "meta"), {"seed": 0, "splits": counts})
    (text,) = [r["value"] for r in spark.read.text(str(tmp_path / "meta")).collect()]
    assert json.loads(text)["splits"] == {"train": {"pairs": 12, "positives": 6, "negatives": 6}, "valid": {"pairs": 4, "positives": 2, "negatives": 2}, "test": {"pairs": 4, "positives": 2, "negatives": 2}}


def test_checkpoints_and_missing_paths(spark, tmp_path):
    model = neural.RecordTransformer.random(seed=3)
    paths = runs.save_checkpoint(model, str(tmp_path), {"seed": 3}, best=True)
    again = neural.RecordTransformer.load(paths[0])
    assert len(paths) == 2 and all((again.weights[k] == v).all() for k, v in model.weights.items())
    table = spark.createDataFrame([(paths[0],), (None,), ("gone.npz",), ("gone.npz",)], "path string")
    assert lookups.missing_paths(table, "path", paths) == ["gone.npz"]


def test_places_are_read(spark, tmp_path):
    line = "\t".join(["US", "62701", "Springfield", "Illinois", "IL", "Sangamon", "167", "", "", "39.8", "-89.6", "4"])
    (tmp_path / "p.txt").write_text(line + "\n" + line.replace("62701", "") + "\n")
    assert [tuple(r) for r in lookups.read_places(spark, str(tmp_path / "p.txt")).collect()] == [("62701", "Springfield", "IL")]


def test_first_candidates(spark):
    df = spark.createDataFrame([(1, 5, 0.5), (1, 6, 0.9), (1, 4, 0.5), (2, 7, 0.1)], "left_id int, right_id int, score double")
    assert sorted((r["left_id"], r["right_id"], r["rank"]) for r in selector.first_candidates(df, 2).collect()) == [(1, 4, 2), (1, 6, 1), (2, 7, 1)]


def test_windowed_counts_of_a_stream(spark, tmp_path):
    rows = [("2024-01-01 00:00:01", "a"), ("2024-01-01 00:04:59", "a"), ("2024-01-01 00:05:00", "b")]
    spark.createDataFrame(rows, "t string, k string").select(F.to_timestamp("t").alias("ts"), "k").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, k string").parquet(str(tmp_path / "in"))
    query = incremental.windowed_counts(stream, "ts", "k").writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((str(r["window_start"]), r["k"], r["n"]) for r in spark.table("windowed").collect()) == [("2024-01-01 00:00:00", "a", 2), ("2024-01-01 00:05:00", "b", 1)]


def _brute(model, rows, fields, block):
    """Scores of all pairs of rows, block by block, by the model on whole tables."""
    import pandas as pd

    table, out = pd.DataFrame(rows), {}
    for _, some in table.groupby(block, dropna=False):
        some = some.sort_values("id").reset_index(drop=True)
        p, ids = model.predict(some, fields), some["id"].tolist()
        out |= {(ids[i], ids[j]): p[i, j] for i in range(len(ids)) for j in range(i + 1, len(ids))}
    return out


@pytest.mark.parametrize("decoder", ["pair_mlp", "pair_difference", "slot_coassignment", "slot_pair_mlp"])
def test_blocks_in_chunks_score_as_whole_ones(spark, monkeypatch, decoder):
    """Blocks of many chunks and tiles, copies of records, nulls, and a block without a key."""
    import random

    monkeypatch.setattr(neural, "CHUNK", 7)
    monkeypatch.setattr(neural, "TILE", 5)
    monkeypatch.setattr(neural, "PACK", 2)
    g = random.Random(4)
    rows = [{"id": f"r{i:03d}", "b": g.choice(["p", "q", None]), "name": g.choice([None, *[f"name {k}" for k in range(9)]]), "x": g.choice([None, 0.25, 7.5, -3.0]), "c": g.choice(["u", "v", "w", None]), "d": g.choice(["2024-01-31", "soon"])} for i in range(90)]
    rows += [{**rows[k], "id": f"s{k}{i}"} for k in (0, 1, 2) for i in range(9)]
    fields = {"name": "text", "x": "numeric", "c": "categorical", "d": "date"}
    df = spark.createDataFrame(rows, "id string, b string, name string, x double, c string, d string")
    model = neural.RecordTransformer.random(neural.TransformerConfig(decoder=decoder, representer="entity_target", slots=5), seed=3)
    found = {(r["left_id"], r["right_id"]): r["score"] for r in neural.score_blocks(df, model, "id", fields, "b").collect()}
    wanted = _brute(model, rows, fields, "b")
    assert found.keys() == wanted.keys() and max(abs(found[k] - wanted[k]) for k in wanted) < 1e-9
    # the same components from few links as from all pairs at a threshold
    threshold = sorted(wanted.values())[2 * len(wanted) // 3] - 1e-9
    links = neural.block_links(df, model, "id", fields, "b", threshold)
    whole = spark.createDataFrame([k for k, p in wanted.items() if p >= threshold], "left_id string, right_id string")
    of = lambda edges: {r["id"]: r["component_id"] for r in graph.component_labels(df.select("id"), edges, "id").collect()}
    assert of(links) == of(whole)


def test_large_blocks_and_copies(spark, tmp_path):
    """4,100 records of a nation are no error, and 100 copies of a record are one class, which is attended and compared once."""
    from kindred import queries

    rows = [(i, f"Supplier#{i % 41}", 1, float(i % 41)) for i in range(4100)]
    df = spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")
    df.write.parquet(f"{tmp_path}/supplier.parquet")
    assert queries.queries()["transformer_blocks_supplier"](spark, str(tmp_path)).count() == 4100 * 4099 // 2
    classes, members = neural._represented(df, neural.RecordTransformer.random(), "s_suppkey", {"s_name": "text", "s_acctbal": "numeric"}, "s_nationkey")
    assert classes.count() == 41 and members.count() == 4100


def test_few_links_span_a_tile():
    g = np.random.default_rng(0)
    for share in (0.01, 0.05, 0.5):
        links = g.random((40, 30)) < share
        i, j = neural.spanning(links)
        assert links[i, j].all() and len(i) < 70

        def parts(pairs):
            up = list(range(70))
            for a, b in pairs:
                x, y = up[a], up[40 + b]
                up = [min(x, y) if u in (x, y) else u for u in up]
            return up

        assert parts(zip(i, j)) == parts(zip(*np.nonzero(links)))
