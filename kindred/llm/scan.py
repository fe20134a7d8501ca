"""Running sums within keys of any size: a global sort, sums within its parts, then what earlier parts carry over."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.shared import map_arrow, written

#: Sums wrap at 62 bits, so that two of them add up within a long.
MASK = (1 << 62) - 1


def _summed(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sums from each begin on, which wrap."""
    total = np.cumsum(values.view(np.uint64), dtype=np.uint64)
    before = (total - values.view(np.uint64))[np.flatnonzero(begins)]
    return total - before[np.cumsum(begins) - 1]


def running(rows: DataFrame, key: str, order: list[Column], made: dict[str, Column], sums: list[str], name: str) -> DataFrame:
    """A written table of the key (a long without nulls) and the columns made, of which those named in sums (longs) become
    running sums over the key's rows in order, modulo 2 ** 62.

    made is evaluated after the sort, so what is only sorted by goes no further. A key may have any number of rows: parts
    of the sort are summed on their own, and a row for each part tells what it carries over.
    """
    sorted_ = rows.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    chosen = sorted_.select(F.col(key), *[c.alias(n) for n, c in made.items()])
    fields = chosen.columns
    places = [fields.index(n) for n in sums]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, row, last, carried = TaskContext.get().partitionId(), 0, None, None
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            keys = batch.column(0).to_numpy()
            begins = np.ones(n, bool)
            begins[1:] = keys[1:] != keys[:-1]
            group = np.cumsum(begins) - 1
            columns = list(batch.columns)
            ends = []
            for k, place in enumerate(places):
                total = _summed(batch.column(place).to_numpy(), begins)
                if last == keys[0]:
                    total[group == 0] += carried[k]
                ends.append(total[-1])
                columns[place] = pa.array((total & np.uint64(MASK)).view(np.int64))
            last, carried = keys[-1], ends
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(row, row + n))], names=[*fields, "_part", "_row"])
            row += n

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema) + ", _part int, _row long"
    table = written(map_arrow(chosen, work, schema), name)
    ends = table.groupBy("_part").agg(F.min_by(key, "_row").alias("head"), F.max_by(F.struct(key, *sums), "_row").alias("tail")).orderBy("_part").collect()
    carries, before = [], None
    for r in ends:  # one for each part
        tail = list(r["tail"])
        if before and before[0] == r["head"]:
            carries.append((r["_part"], r["head"], *before[1:]))
            if tail[0] == r["head"]:
                tail[1:] = [a + b & MASK for a, b in zip(tail[1:], before[1:])]
        before = tail
    out = table.drop("_part", "_row")
    if not carries:
        return out
    more = rows.sparkSession.createDataFrame(carries, f"_part int, `{key}` long, " + ", ".join(f"_{n} long" for n in sums))
    joined = table.join(F.broadcast(more), ["_part", key], "left")
    return joined.select(*[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).bitwiseAND(F.lit(MASK)).alias(c) if c in sums else F.col(c) for c in out.columns])
