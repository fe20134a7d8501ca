"""Benchmark catalogs: a JSON manifest of CSV files with field types, checked and loaded as record tables."""

from __future__ import annotations

import json
import posixpath
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.operators.records import FIELD_TYPES, sample_entities
from kindred.sources import csvsplit

KINDS = ("single_table", "linkage", "deduplication", "smoke", "real", "synthetic")
REQUIRED = ("kind", "description", "file", "entity_id_column", "field_types")
#: Pairs that are evaluated: all, those whose sources differ, or those that rows with one pair id make.
PAIR_SCOPES = ("all_pairs", "cross_source", "paired_rows")
#: How paired rows are told, where a manifest doesn't say otherwise (fixed values).
PAIRED = {"pair": "pair_id", "side": "source_table", "left": "profile1", "right": "profile2", "label": "match_label"}
SAMPLE_KEYS = {"n_entities", "seed", "require_positive_pairs", "require_variation"}


def validate_config(name: str, config: dict[str, Any], kinds: tuple[str, ...] | None = None) -> None:
    """Raise ValueError if a manifest entry is not usable."""
    if missing := sorted(set(REQUIRED) - set(config)):
        raise ValueError(f"benchmark {name!r} lacks {missing}")
    if kinds and config["kind"] not in kinds:
        raise ValueError(f"benchmark {name!r} has the unknown kind {config['kind']!r}")
    if odd := sorted(set(config["field_types"].values()) - set(FIELD_TYPES)):
        raise ValueError(f"benchmark {name!r} has unknown field types {odd}")
    if both := sorted(set(config.get("ignored_columns", ())) & set(config["field_types"])):
        raise ValueError(f"benchmark {name!r} both ignores and uses {both}")
    if config.get("pair_scope", "all_pairs") not in PAIR_SCOPES:
        raise ValueError(f"benchmark {name!r} has the unknown pair scope {config['pair_scope']!r}")
    if odd := sorted(set(config.get("paired_rows", ())) - set(PAIRED)):
        raise ValueError(f"benchmark {name!r} has unknown paired_rows keys {odd}")
    sample = config.get("entity_sample")
    if sample is None:
        return
    if odd := sorted(set(sample) - SAMPLE_KEYS):
        raise ValueError(f"benchmark {name!r} has unknown entity_sample keys {odd}")
    for key, kind in (("n_entities", int), ("seed", int), ("require_positive_pairs", bool), ("require_variation", bool)):
        if not isinstance(sample.get(key), kind) or kind is int and isinstance(sample[key], bool):
            raise ValueError(f"entity_sample.{key} of benchmark {name!r} must be {kind.__name__}")


def quote_identifier(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def is_utf8(spark: SparkSession, path: str) -> bool:
    """True if every line of a text file is valid UTF-8; tasks look through the whole file."""
    return spark.read.text(path).filter(~F.is_valid_utf8("value")).isEmpty()


def read_text_csv(spark: SparkSession, path: str, columns: list[str] | None = None, encoding: str | None = None, sep: str = ",") -> DataFrame:
    """A CSV file with all columns as strings; the encoding is UTF-8 (with or without a mark), or Latin-1 if a line isn't valid.

    Without an encoding the file is read once more, to tell. Quoted fields may hold line breaks; a file is read in splits.
    """
    if encoding is None:
        encoding = "UTF-8" if is_utf8(spark, path) else "ISO-8859-1"
    if encoding.lower() in csvsplit.BYTEWISE:
        df = csvsplit.read_csv(spark, path, encoding, sep)
    else:  # such files can't be cut by bytes: a task for each file
        df = spark.read.option("header", True).option("inferSchema", False).option("encoding", encoding).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    return df.select(*[quote_identifier(c) for c in columns]) if columns else df


@dataclass(frozen=True)
class Benchmark:
    """A loaded benchmark: records have the entity and field columns, and source_table if the manifest names one."""

    name: str
    kind: str
    description: str
    records: DataFrame
    entity: str
    field_types: dict[str, str]
    pair_scope: str = "all_pairs"
    #: Of the scope paired_rows: the columns pair, side and label, and what side holds left and right.
    paired: dict[str, str] | None = None

    @property
    def fields(self) -> list[str]:
        return list(self.field_types)


class Catalog:
    """The benchmarks of a manifest, by name; keys that begin with an underscore describe the manifest itself."""

    def __init__(self, spark: SparkSession, manifest: str | dict[str, Any], root: str = ""):
        self.spark = spark
        self.root = root or (posixpath.dirname(manifest) if isinstance(manifest, str) else "")
        if isinstance(manifest, str):
            manifest = json.loads("\n".join(r["value"] for r in spark.read.text(manifest).collect()))  # one small file
        self.configs = {k: v for k, v in manifest.items() if not k.startswith("_")}
        for name, config in self.configs.items():
            validate_config(name, config)

    def names(self) -> list[str]:
        return list(self.configs)

    def load(self, name: str) -> Benchmark:
        if name not in self.configs:
            raise ValueError(f"unknown benchmark {name!r}; there are {self.names()}")
        config = self.configs[name]
        entity, fields = config["entity_id_column"], list(config["field_types"])
        source = config.get("source_table_column", "source_table" if "source_table" in config.get("ignored_columns", ()) else None)
        scope, paired = config.get("pair_scope", "all_pairs"), None
        more = [source] if source else []
        if scope == "paired_rows":
            paired = PAIRED | config.get("paired_rows", {})
            more += [paired[k] for k in ("pair", "side", "label")]
        columns = [*dict.fromkeys([entity, *fields, *more])]
        path = posixpath.join(self.root, config["file"]) if self.root else config["file"]
        records = read_text_csv(self.spark, path, columns)
        if sample := config.get("entity_sample"):
            records = sample_entities(records, entity, fields, **sample)
        return Benchmark(name, config["kind"], config["description"], records, entity, dict(config["field_types"]), scope, paired)

    def load_all(self, names: list[str] | None = None) -> list[Benchmark]:
        return [self.load(n) for n in names or self.names()]

    def metadata(self) -> DataFrame:
        """benchmark, kind, description, n_fields, field_summary of each entry."""
        rows = [(n, c["kind"], c["description"], len(c["field_types"]), "; ".join(f"{f}:{t}" for f, t in c["field_types"].items())) for n, c in self.configs.items()]
        return self.spark.createDataFrame(rows, "benchmark string, kind string, description string, n_fields int, field_summary string")


def results_table(metadata: DataFrame, results: DataFrame, model_names: dict[str, str]) -> DataFrame:
    """Join results (benchmark, baseline, policy, n_records, ...) with metadata; adds n_pairs and model."""
    names = F.create_map(*[x for k, v in model_names.items() for x in (F.lit(k), F.lit(v))]) if model_names else None
    fallback = F.concat_ws(":", "baseline", "policy")
    model = F.coalesce(names[F.col("policy")], fallback) if names is not None else fallback
    joined = metadata.join(results.withColumnRenamed("n_fields", "_fields") if "n_fields" in results.columns else results, "benchmark", "right")
    if "_fields" in joined.columns:
        joined = joined.withColumn("n_fields", F.coalesce("_fields", "n_fields")).drop("_fields")
    return joined.withColumn("n_pairs", F.expr("n_records * (n_records - 1) div 2")).withColumn("model", model)


def with_run_metadata(df: DataFrame, **values: Any) -> DataFrame:
    """Add constant columns; lists and dictionaries as JSON."""
    for k, v in values.items():
        df = df.withColumn(k, F.lit(json.dumps(v, sort_keys=True) if isinstance(v, (dict, list)) else v))
    return df
