"""Sinks: tables, resumable JSON lines, pair files, run metadata."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.text import serialize_colval
from kindred.storage import path_exists


def write_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """A CSV folder with a header; an existing one is an error unless overwrite."""
    df.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)


def remaining(df: DataFrame, path: str, keys: list[str], schema: str) -> DataFrame:
    """Rows whose keys a folder of JSON lines doesn't have yet."""
    spark = df.sparkSession
    if not path_exists(spark, path):
        return df
    return df.join(spark.read.schema(schema).json(path).select(*keys).distinct(), keys, "left_anti")


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def pair_lines(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """left, right (serialised records), label."""
    text = lambda s: F.regexp_replace(serialize_colval([f"{s}_{c}" for c in columns]), f"COL {s}_", "COL ")
    return pairs.select(text("left").alias("left"), text("right").alias("right"), F.col("label").cast("string").alias("label"))


def write_pair_files(pairs: DataFrame, columns: list[str], folder: str) -> None:
    """For each split: tab-separated lines of serialised pairs, and a CSV of ids and labels."""
    for (split,) in pairs.select("split").distinct().collect():  # a few names
        some = pairs.filter(F.col("split") == split)
        pair_lines(some, columns).write.mode("errorifexists").option("sep", "\t").option("quote", "").csv(f"{folder}/{split}")
        some.select(F.col("left_id").alias("left_index"), F.col("right_id").alias("right_index"), "label").write.mode("errorifexists").option("header", True).csv(f"{folder}/{split}_pairs")


def write_record_lines(records: DataFrame, columns: list[str], path: str) -> None:
    records.select(serialize_colval(columns).alias("value")).write.mode("errorifexists").text(path)


def write_metadata(spark: SparkSession, path: str, values: dict[str, Any]) -> None:
    """One JSON document, through Spark, so that any store will do."""
    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def run_id(config: dict[str, Any]) -> str:
    """A name for a configuration, from the SHA-256 of its JSON."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:12]
