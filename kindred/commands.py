"""Further commands: python -m kindred.commands export|select|table ...

export writes a benchmark as pair files with splits and metadata; select runs a candidate selector over two tables and goes on
where an earlier run ended; table puts several result files and a manifest's metadata into one.
"""

from __future__ import annotations

import argparse
import json
import posixpath
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import text as X
from kindred.operators import metrics, pairs
from kindred.operators.records import with_positions
from kindred.sources import catalog, csvsplit, selector, sinks
from kindred.storage import path_exists, written

SPLITS = ("train", "valid", "test")


def export_task(spark: SparkSession, benchmark: catalog.Benchmark, folder: str, sizes: dict[str, int], seed: int = 0, most: int = pairs.MAX_PAIRS) -> dict:
    """Write records, their serialised lines, pairs by split and all pairs; returns the metadata, which is written as well.

    Folders: records (CSV), train_no_label, tableA and tableB (a line a record, in order; and CSVs of the same), one for each
    split and for all_pairs (serialised pairs with labels), `<split>_pairs` (ids and labels) and metadata.
    """
    fields = benchmark.fields
    records = written(with_positions(benchmark.records.withColumnRenamed(benchmark.entity, "entity_id"), ["entity_id", *fields], "record_index"), "task-records")
    lined = records.withColumn("serialized", X.serialize_colval(fields))
    sinks.write_csv(lined.select("record_index", "entity_id", *fields, "serialized"), f"{folder}/records")
    for stem in ("train_no_label", "tableA", "tableB"):  # one table is matched with itself, so both sides are the same
        sinks.write_record_lines(records.repartitionByRange("record_index").sortWithinPartitions("record_index"), fields, f"{folder}/{stem}")
    for stem in ("tableA", "tableB"):
        sinks.write_csv(lined.select("record_index", "serialized"), f"{folder}/{stem}_index")
    every = pairs.all_pairs(records, "record_index", ["entity_id", *fields], most)
    labelled = metrics.with_target(every).withColumnRenamed("target", "label")
    keyed = labelled.select("left_id", "right_id", "label")
    split = written(pairs.split_pairs(keyed, sizes, seed).unionByName(keyed.withColumn("split", F.lit("all_pairs"))), "task-pairs")
    named = split
    for side in ("left", "right"):
        named = named.join(records.select(F.col("record_index").alias(f"{side}_id"), *[F.col(c).alias(f"{side}_{c}") for c in fields]), f"{side}_id")
    sinks.write_pair_files(written(named, "task-pairs"), fields, folder)
    counts = {r["split"]: {"n_pairs": r["pairs"], "n_positive_pairs": r["positives"], "n_negative_pairs": r["negatives"]} for r in metrics.split_counts(split).collect()}
    size = records.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity_id").alias("e")).first()
    nothing = {"n_pairs": 0, "n_positive_pairs": 0, "n_negative_pairs": 0}
    metadata = {"benchmark": benchmark.name, "n_records": size["n"], "n_entities": size["e"], **counts.pop("all_pairs", nothing), "splits": {s: counts.get(s, nothing) for s in sizes}, "serialization": "COL {field} VAL {value}", "seed": seed}
    sinks.write_metadata(spark, f"{folder}/metadata", metadata)
    return metadata


def _id(name: str):
    """An id as text, without the `.0` that a float column gives a whole number."""
    return F.regexp_replace(F.trim(F.col(name).cast("string")), "\\.0$", "")


RESULT = "dataset string, field_mode string, row_index long, left_id string, candidate_ids array<string>, prediction int, predicted_id string, prompt_tokens long, completion_tokens long, error string, has_match boolean, candidate_hit boolean, correct boolean"


def select_candidates(spark: SparkSession, name: str, config: dict, output: str, top_k: int = 10, field_mode: str = "all", offset: int = 0, limit: int | None = None, answer: Callable[[str], str | selector.Answer] = selector.overlap_answer, root: str = "") -> DataFrame:
    """Ask a selector about each left row's top_k candidates, but for rows that the output has already; returns its metrics.

    config: left, right and matches (CSV files), left_id, right_id, left_match and right_match (columns), and short_fields
    (lists left and right) for the field mode short. offset and limit count left rows in the order of their file; a row's
    key is the dataset and that place. Rows are appended to the output, a folder of JSON lines.
    """
    if field_mode not in ("all", "short"):
        raise ValueError(f"unknown field mode {field_mode!r}")
    at = lambda k: posixpath.join(root, config[k]) if root else config[k]
    placed = csvsplit.read_csv(spark, at("left"), config.get("encoding", "UTF-8"), place="_place")
    left = with_positions(placed, "_place", "row_index").drop("_place").filter(F.col("row_index") >= offset)
    left = left.filter(F.col("row_index") < offset + limit) if limit is not None else left
    done = spark.createDataFrame([(name,)], "dataset string")
    left = sinks.remaining(left.crossJoin(F.broadcast(done)), output, ["dataset", "row_index"], RESULT)  # one row
    right = catalog.read_text_csv(spark, at("right"), encoding=config.get("encoding"))
    matches = catalog.read_text_csv(spark, at("matches"), encoding=config.get("encoding")).select(_id(config["left_match"]).alias("left_id"), _id(config["right_match"]).alias("right_id")).distinct()
    short = config.get("short_fields", {}) if field_mode == "short" else {}
    sides = {}
    for side, table in (("left", left), ("right", right)):
        key = config[f"{side}_id"]
        fields = short.get(side) or [c for c in table.columns if c not in (key, "row_index", "dataset")]
        kept = [_id(key).alias("_id"), X.serialize_record(fields).alias("text"), *(["row_index"] if side == "left" else [])]
        sides[side] = written(table.select(*kept), f"selector-{side}")
    l, r = sides["left"], sides["right"]
    found = pairs.tfidf_neighbours(l.withColumn("key", F.col("row_index").cast("string")), r, "key", "text", "_id", "text", top_k)
    prompts = selector.candidate_prompts(found, l.select(F.col("row_index").cast("string").alias("key"), F.col("text").alias("record")), r.withColumnRenamed("text", "record"), "key", "_id", ["record"], ["record"])
    chosen = selector.select(prompts, answer).withColumnRenamed("left_id", "key")
    named = l.select(F.col("row_index"), F.col("_id").alias("left_id")).join(chosen, F.col("row_index").cast("string") == F.col("key")).drop("key")
    judged = selector.judge_selection(named, matches)
    rows = named.join(judged.select("left_id", "has_match", "candidate_hit", "correct").distinct(), "left_id")
    out = rows.withColumn("dataset", F.lit(name)).withColumn("field_mode", F.lit(field_mode))
    sinks.append_json(out.select(*[c.split()[0] for c in RESULT.split(", ")]), output)
    return metrics.selector_metrics(spark.read.schema(RESULT).json(output).filter(F.col("dataset") == name))


def combined_table(spark: SparkSession, manifest: str, inputs: list[str], models: dict[str, str] | None = None, existing: str | None = None) -> DataFrame:
    """Result files (CSV folders or files) as one table with the manifest's metadata, after the rows of an existing table."""
    metadata = catalog.Catalog(spark, manifest).metadata()
    rows = None
    for path in inputs:
        some = spark.read.option("header", True).csv(path)
        some = some.withColumnRenamed("name", "benchmark") if "benchmark" not in some.columns else some
        for missing in {"baseline", "policy"} - set(some.columns):
            some = some.withColumn(missing, F.lit(None).cast("string"))
        rows = some if rows is None else rows.unionByName(some, allowMissingColumns=True)
    table = catalog.results_table(metadata, rows, models or {})
    if existing and path_exists(spark, existing):
        table = spark.read.option("header", True).csv(existing).unionByName(table.select([F.col(c).cast("string") for c in table.columns]), allowMissingColumns=True)
    return table


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    e = sub.add_parser("export")
    e.add_argument("manifest")
    e.add_argument("--benchmarks", nargs="*")
    for s, n in zip(SPLITS, (5000, 2000, 5000)):
        e.add_argument(f"--{s}-pairs", type=int, default=n)
    e.add_argument("--seed", type=int, default=0)
    e.add_argument("--out", required=True)
    s = sub.add_parser("select")
    s.add_argument("datasets", help="a JSON file of datasets by name")
    s.add_argument("--dataset", required=True)
    s.add_argument("--top-k", type=int, default=10)
    s.add_argument("--field-mode", choices=["all", "short"], default="all")
    s.add_argument("--offset", type=int, default=0)
    s.add_argument("--limit", type=int)
    s.add_argument("--output", required=True)
    t = sub.add_parser("table")
    t.add_argument("manifest")
    t.add_argument("inputs", nargs="+")
    t.add_argument("--existing")
    t.add_argument("--out", required=True)
    o = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if o.command == "export":
        found = catalog.Catalog(spark, o.manifest)
        for b in found.load_all(o.benchmarks):
            export_task(spark, b, f"{o.out}/{b.name}", {s: getattr(o, f"{s}_pairs") for s in SPLITS}, o.seed)
    elif o.command == "select":
        datasets = json.loads("\n".join(r["value"] for r in spark.read.text(o.datasets).collect()))  # one small file
        select_candidates(spark, o.dataset, datasets[o.dataset], o.output, o.top_k, o.field_mode, o.offset, o.limit, root=posixpath.dirname(o.datasets)).show(truncate=False)
    else:
        sinks.write_csv(combined_table(spark, o.manifest, o.inputs, existing=o.existing).coalesce(1), o.out)


if __name__ == "__main__":
    main()
