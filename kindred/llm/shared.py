"""Helpers that all operators of this subpackage use: shipping, Arrow functions, memory of workers, heavy keys."""

from __future__ import annotations

import contextlib
import ctypes
import os
import sys
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from kindred.storage import drop_tables, scratch, written

__all__ = ["add_arrow", "drop_tables", "held_out", "lookup", "map_arrow", "raw", "scratch", "ship", "slices", "written"]

#: A key is heavy if it holds more than one row in so many; there can be no more heavy keys than that.
HEAVY_SHARE = 1000


_shipped: dict[str, bool] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, for those that don't have it on their path."""
    app = spark.sparkContext.applicationId
    if _shipped.get(app):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="kindred-ship-"), "kindred_ship.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(target)
    _shipped[app] = True


def _free() -> None:
    """Give a worker's unused memory back to the system: it lives on for other tasks, beside its executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(Exception):  # other C libraries have no such function
        ctypes.CDLL(None).malloc_trim(0)


def _tidied(work: Callable[[Iterator], Iterator], encodes: bool) -> Callable[[Iterator], Iterator]:
    """The same work; before it, the token encoder's memory of words goes if the work has no use for it."""

    def run(batches: Iterator) -> Iterator:
        if not encodes and (tokens := sys.modules.get("kindred.llm.tokens")):
            tokens.forget()
        yield from work(batches)
        _free()

    return run


def map_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, encodes: bool = False) -> DataFrame:
    """mapInArrow; encodes: the work uses a token encoder."""
    ship(df.sparkSession)
    return df.mapInArrow(_tidied(work, encodes), schema)


def add_arrow(df: DataFrame, name: str, work: Callable[[Iterator[pa.Array]], Iterator[pa.Array]], schema: str, column: Column) -> DataFrame:
    """Add what work makes of a column. Only that column goes to Python and only the result comes back; the rows wait in the JVM.

    It is marked as not deterministic, so that the optimiser evaluates it once however often the result is used.
    """
    ship(df.sparkSession)
    run = _tidied(work, False)

    def made(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from run(arrays)

    return df.withColumn(name, arrow_udf(made, schema).asNondeterministic()(column))


def slices(batch: pa.RecordBatch, column: int, rows: int = 500, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of so many rows, and of about so many bytes of a text column, or a row."""
    texts = batch.column(column)
    if not len(texts):
        return
    ends = pc.cumulative_sum(pc.binary_length(texts).fill_null(0).cast(pa.int64())).to_numpy()
    at, before = 0, 0
    while at < len(batch):
        stop = min(max(int(np.searchsorted(ends, before + size, "right")), at + 1), at + rows, len(batch))
        yield batch.slice(at, stop - at)
        at, before = stop, int(ends[stop - 1])


def raw(column: pa.Array) -> Iterator[bytes | None]:
    """Strings as UTF-8 bytes, without decoding, one at a time."""
    kind = column.type
    if pa.types.is_large_string(kind):
        column = column.cast(pa.large_binary())
    elif pa.types.is_string(kind):
        column = column.cast(pa.binary())
    return (x.as_py() for x in column)


def held_out(id_column: str | Column) -> Column:
    """True if crc32 of the id's text leaves remainder 1 by 3."""
    return F.crc32(F.col(id_column).cast("string") if isinstance(id_column, str) else id_column.cast("string")) % 3 == 1


def lookup(rows: DataFrame, table: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left join of rows with a table of one row per key; rows of heavy keys stay where they are.

    size: the table's column with the number of rows that have the key; total: all rows. A heavy key has more
    than total / HEAVY_SHARE rows, so there are fewer than HEAVY_SHARE of them: their part of the table is sent to all
    tasks, and only the other rows, of keys that no task finds too large, are shuffled. Rows are read twice.
    """
    heavy = F.col(size) > F.lit(max(1000, total // HEAVY_SHARE))
    large = F.broadcast(table.filter(heavy))
    light = rows.join(large.select(key), key, "left_anti").join(table.filter(~heavy), key, "left")
    return rows.join(large, key).select(*light.columns).unionByName(light)
