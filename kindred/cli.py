"""Run baselines on the benchmarks of a manifest: python -m kindred.cli manifest.json --scorer fellegi_sunter --out folder."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.operators import metrics, pairs, runs, score
from kindred.operators.records import with_positions
from kindred.sources import catalog, sinks
from kindred.storage import written

METRICS = ["prevalence", "roc_auc", "pr_auc", "pair_precision", "pair_recall", "pair_f1", "best_pair_f1", "best_pair_threshold", "adjusted_rand", "candidate_pairs", "candidate_fraction", "true_pair_candidate_recall"]


def candidates(records: DataFrame, field_types: dict[str, str], policy: str, ratio: float, scope: str = "all_pairs", purge: bool = True, prune: bool = True) -> DataFrame:
    """Pairs by policy: all, rules or tokens; with scope cross_source, of records whose source_table differs."""
    names, kept = list(field_types), [*field_types, "entity_id", *(["source_table"] if scope == "cross_source" and "source_table" not in field_types else [])]
    if scope == "cross_source" and "source_table" not in records.columns:
        raise ValueError("records have no source_table")
    if policy == "all":
        return pairs.cross_source_pairs(records, "record_id", "source_table", kept) if scope == "cross_source" else pairs.all_pairs(records, "record_id", kept)
    if policy == "rules":
        found = pairs.blocked_pairs(records, "record_id", pairs.blocking_rules(field_types), kept)
    else:
        blocks = pairs.token_blocks(records, "record_id", names)
        blocks = pairs.filter_blocks(pairs.purge_blocks(blocks) if purge else blocks.join(pairs.block_sizes(blocks), "token"), ratio)
        found = pairs.block_pairs(blocks)
        found = pairs.weighted_edge_pruning(found) if prune else found
        for side in ("left", "right"):
            found = found.join(records.select(F.col("record_id").alias(f"{side}_id"), *[F.col(c).alias(f"{side}_{c}") for c in kept]), f"{side}_id")
    return found.filter("left_source_table <> right_source_table") if scope == "cross_source" else found


def paired(records: DataFrame, how: dict[str, str]) -> DataFrame:
    """left_id, right_id, target of the pairs that rows with one pair id make; the label is that of the smaller id's row."""
    both = pairs.paired_rows(records, how["pair"], how["side"], how["left"], how["right"], ["record_id", how["label"]])
    a, b = F.col("left_record_id"), F.col("right_record_id")
    label = F.when(a < b, F.col(f"left_{how['label']}")).otherwise(F.col(f"right_{how['label']}"))
    return both.select(F.least(a, b).alias("left_id"), F.greatest(a, b).alias("right_id"), F.coalesce(F.lower(label.cast("string")) == "true", F.lit(False)).cast("int").alias("target"))


def run(benchmark: catalog.Benchmark, scorer: str, policy: str, recall: float, max_u_pairs: int, ratio: float, threshold: float, scope: str | None = None, purge: bool = True, prune: bool = True) -> DataFrame:
    """The metrics row of one benchmark; scope: the manifest's, if not given. Pairs outside the scope take no part."""
    scope = scope or benchmark.pair_scope
    records = with_positions(benchmark.records.withColumnRenamed(benchmark.entity, "entity_id"), ["entity_id", *benchmark.fields], "record_id")
    totals = None
    if scope == "paired_rows":
        universe = written(paired(records, benchmark.paired or catalog.PAIRED), "paired-rows")
        totals = tuple(universe.agg(F.count(F.lit(1)), F.coalesce(F.sum("target"), F.lit(0))).first())
        if policy == "all":
            found = universe.drop("target")
            for side in ("left", "right"):
                found = found.join(records.select(F.col("record_id").alias(f"{side}_id"), *[F.col(c).alias(f"{side}_{c}") for c in benchmark.fields]), f"{side}_id")
        else:
            found = candidates(records, benchmark.field_types, policy, ratio, "all_pairs", purge, prune).join(universe.drop("target"), ["left_id", "right_id"], "left_semi")
    else:
        found = candidates(records, benchmark.field_types, policy, ratio, scope, purge, prune)
        if scope == "cross_source":
            totals = tuple(metrics.scope_totals(records, "entity_id", "source_table").first())
    if scorer == "fellegi_sunter":
        model: score.PairScorer = score.fit_fellegi_sunter(records, "record_id", benchmark.field_types, recall, max_u_pairs)
    else:
        model = {"jaccard": score.JaccardScorer, "evidence": score.EvidenceScorer}[scorer]()
    scored = model.score_pairs(found, benchmark.field_types)
    scored = scored.join(universe, ["left_id", "right_id"]) if scope == "paired_rows" else metrics.with_target(scored)
    return metrics.evaluate(benchmark.name, records, "record_id", "entity_id", scored.select("left_id", "right_id", "score", "target"), threshold, totals=totals)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("manifest")
    p.add_argument("--benchmarks", nargs="*")
    p.add_argument("--scorer", choices=["fellegi_sunter", "jaccard", "evidence"], default="jaccard")
    p.add_argument("--policy", choices=["all", "rules", "tokens"], default="tokens")
    p.add_argument("--prior-recall", type=float, default=0.7)
    p.add_argument("--max-u-pairs", type=int, default=1_000_000)
    p.add_argument("--ratio", type=float, default=0.9)
    p.add_argument("--threshold", type=float, default=0.5)
    p.add_argument("--pair-scope", choices=list(catalog.PAIR_SCOPES), help="the manifest's, if not given")
    p.add_argument("--no-purging", action="store_true", help="keep the largest token blocks")
    p.add_argument("--no-pruning", action="store_true", help="keep pairs of few shared blocks")
    p.add_argument("--offset", type=int, default=0, help="benchmarks to leave out at the start")
    p.add_argument("--limit", type=int, help="benchmarks to run")
    p.add_argument("--out", required=True)
    o = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    found = catalog.Catalog(spark, o.manifest)
    rows = None
    names = (o.benchmarks or found.names())[o.offset :][: o.limit]
    for b in found.load_all(names) if names else ():
        row = runs.guarded(spark, b.name, lambda b=b: run(b, o.scorer, o.policy, o.prior_recall, o.max_u_pairs, o.ratio, o.threshold, o.pair_scope, not o.no_purging, not o.no_pruning), METRICS)
        row = catalog.with_run_metadata(row, scorer=o.scorer, policy=o.policy, pair_scope=o.pair_scope or b.pair_scope)
        rows = row if rows is None else rows.unionByName(row)
    if rows is not None:
        sinks.write_csv(rows.coalesce(1), o.out)


if __name__ == "__main__":
    main()
