"""Tables about runs: histories, best steps, guarded runs, model files, summaries of worlds."""

from __future__ import annotations

import math
import posixpath
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.operators.metrics import best_rows
from kindred.operators.neural import RecordTransformer
from kindred.operators.records import with_positions
from kindred.sources.sinks import run_id


def joined_history(history: DataFrame, *others: DataFrame, on: str = "step") -> DataFrame:
    """A run's metrics with its losses and profiles, by step."""
    for other in others:
        history = history.join(other, on, "left")
    return history


def threshold_pivot(history: DataFrame, step: str, name: str, value: str, names: list[str] | None = None) -> DataFrame:
    """One row per step, one column per benchmark."""
    grouped = history.groupBy(step)
    return (grouped.pivot(name, names) if names else grouped.pivot(name)).agg(F.first(value))


def best_and_final(history: DataFrame, name: str, metric: str, step: str) -> DataFrame:
    """name, best_step, best (metric), final_step, final of each benchmark."""
    best = best_rows(history.select(name, step, metric), name, metric, step).select(name, F.col(step).alias("best_step"), F.col(metric).alias("best"))
    final = history.groupBy(name).agg(F.max(step).alias("final_step"), F.max_by(metric, step).alias("final"))
    return best.join(final, name)


def batch_shapes(batches: DataFrame, columns: list[str]) -> DataFrame:
    """One row: min, max and mean of columns, as `min_x`, `max_x`, `mean_x`."""
    return batches.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))])


def page(df: DataFrame, order_by: list[str], offset: int = 0, limit: int | None = None) -> DataFrame:
    """Rows from an offset on, in order."""
    out = df.orderBy(*order_by).offset(offset)
    return out if limit is None else out.limit(limit)


def cap_per_group(df: DataFrame, group: list[str], key: list[str], most: int, seed: int = 0) -> DataFrame:
    """At most so many rows of each group, chosen by the MD5 of their key: a sample for plots."""
    order: Column = F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(order, *key))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= most).drop("_rank")


def shuffled(df: DataFrame, key: list[str], seed: int = 0, place: str | None = None) -> DataFrame:
    """Rows in an order that depends on the seed and the key alone; place: a column for their numbers in it, from 0."""
    order = F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))
    if place is None:
        return df.orderBy(order, *key)
    return with_positions(df.withColumn("_order", order), ["_order", *key], place).drop("_order")


def is_descending(df: DataFrame, value: str, order_by: list[str]) -> bool:
    """True if no value is over the one before it; df is a top-k result, so one window task will do."""
    before = F.lag(value).over(Window.orderBy(*order_by))
    return df.select((F.col(value) > before).alias("up")).filter("up").isEmpty()


def guarded(spark: SparkSession, name: str, run: Callable[[], DataFrame], metrics: list[str]) -> DataFrame:
    """One row with status, error, seconds and the metrics of a run; NaN metrics if it fails."""
    began, error, values = time.time(), None, {m: math.nan for m in metrics}
    try:
        row = run().first()
        values = {m: float(row[m]) if row[m] is not None else math.nan for m in metrics}
    except Exception as e:  # a failed run is a row, too
        error = f"{type(e).__name__}: {str(e)[:500]}"
    fields = ", ".join(f"`{m}` double" for m in metrics)
    return spark.createDataFrame([(name, "failed" if error else "ok", error, time.time() - began, *values.values())], f"name string, status string, error string, seconds double, {fields}")


def save_checkpoint(model: RecordTransformer, folder: str, config: dict, best: bool = False) -> list[str]:
    """Write `<run>-latest.npz` (and `<run>-best.npz`) on the driver; returns the paths."""
    stem = posixpath.join(folder, run_id(config))
    paths = [f"{stem}-{kind}.npz" for kind in ("latest", *(["best"] if best else []))]
    for p in paths:
        model.save(p)
    return paths


def describe_world(records: DataFrame, entity: str, fields: list[str]) -> DataFrame:
    """field, missing_rate, distinct values, and the world's records and entities, a row per field."""
    totals = records.agg(F.count(F.lit(1)).alias("records"), F.count_distinct(entity).alias("entities"))
    stats = records.agg(*[x for c in fields for x in (F.avg(F.col(c).isNull().cast("int")).alias(f"m_{c}"), F.count_distinct(c).alias(f"d_{c}"))])
    rows = F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"m_{c}").alias("missing_rate"), F.col(f"d_{c}").alias("distinct_values")) for c in fields]))
    return stats.select(rows).crossJoin(totals)  # single rows
