"""Whitening of embeddings by a one-sided Jacobi SVD of a blockwise QR factorisation.

Entries become whole numbers (the floor of SCALE times the entry, plus SHIFT), so counts, sums and squared deviations are
exact. Each task centres its rows and reduces them, block after block, to the triangle R of their QR factorisation; up to
FANIN triangles at a time are stacked and reduced again until one is left. Its size is the dimension's square, whatever
the number of rows: it comes to the driver, where plane rotations make its columns orthogonal. Their lengths over the
root of the number of rows are the standard deviations, the product of the rotations holds the components. The covariance
is never formed, so small standard deviations keep their digits. A last scan projects the rows.

Definitions for odd input: rows whose vector is null, or holds a null or an entry that isn't finite, are dropped, and so
are those whose length isn't the most frequent one (of equally frequent lengths, the greatest) and empty vectors; a null id
is kept as such, rows that repeat an id or a vector count each; entries whose multiple exceeds 2 ** 53 count as that; a
squared deviation that a long can't hold is null; components whose standard deviation is zero (to the precision of
doubles) are left out, so a single row, or equal rows, have none; a component's largest entry (the first of those) is
positive; an empty table gives an empty result; other columns are not read, so their names may clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.shared import drop_tables, map_arrow, written

SCALE, SHIFT = 64, 1_000_000
#: Triangles that one task reduces to one.
FANIN = 16
#: Rows that are reduced, or projected, at a time.
BLOCK = 4096
_MOST = float(1 << 53)


def whole_numbers(vectors: pa.Array, width: int) -> np.ndarray:
    """Vectors of a list column without nulls as rows of int64."""
    entries = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(entries * SCALE), -_MOST, _MOST).astype(np.int64).reshape(-1, width) + SHIFT


@dataclass
class Centre:
    """The number of rows, and the sums of their whole numbers by dimension, taken apart as count * floor + rest."""

    count: int
    sums: list[int]

    def __post_init__(self) -> None:
        self.floor = np.array([s // self.count for s in self.sums], np.int64)
        self.rest = [s % self.count for s in self.sums]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.floor) - np.array([r / self.count for r in self.rest])

    def deviations(self, x: np.ndarray) -> list[int]:
        """The exact sum of (count * x - sum) ** 2 of each row."""
        y = x - self.floor
        n = self.count
        largest = n * (int(np.abs(y).max(initial=0)) + 1)
        if x.shape[1] * largest**2 < 1 << 62:
            return ((n * y - np.array(self.rest, np.int64)) ** 2).sum(axis=1).tolist()
        exact = y.astype(object) * n - np.array(self.rest, object)
        return (exact**2).sum(axis=1).tolist()


def triangle(rows: np.ndarray) -> np.ndarray:
    """The square triangle R of the QR factorisation."""
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((r.shape[1] - len(r), r.shape[1]))]) if len(r) < r.shape[1] else r


def _rounds(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of n columns, in rounds of pairs that share none."""
    ring = [*range(n), *[-1] * (n % 2)]
    for _ in range(len(ring) - 1):
        pairs = [(min(a, b), max(a, b)) for a, b in zip(ring[: len(ring) // 2], ring[::-1]) if min(a, b) >= 0]
        if pairs:
            left, right = zip(*pairs)
            yield np.array(left), np.array(right)
        ring = [ring[0], ring[-1], *ring[1:-1]]


def jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and right singular vectors as columns, by plane rotations of the matrix's columns."""
    n = matrix.shape[1]
    size = float(np.abs(matrix).max(initial=0)) or 1.0
    a, v = matrix / size, np.eye(n)
    schedule = list(_rounds(n))
    for _ in range(sweeps):
        turned = False
        for p, q in schedule:
            left, right = a[:, p], a[:, q]
            alpha, beta, gamma = (left * left).sum(axis=0), (right * right).sum(axis=0), (left * right).sum(axis=0)
            turn = np.abs(gamma) > 1e-15 * np.sqrt(alpha) * np.sqrt(beta)
            if not turn.any():
                continue
            turned = True
            p, q = p[turn], q[turn]
            zeta = (beta[turn] - alpha[turn]) / (2 * gamma[turn])
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            cos = 1 / np.hypot(1, t)
            sin = cos * t
            for m in (a, v):
                left, right = m[:, p], m[:, q]
                m[:, p], m[:, q] = cos * left - sin * right, sin * left + cos * right
        if not turned:
            break
    values = np.sqrt((a * a).sum(axis=0)) * size
    order = np.argsort(-values, kind="stable")
    v = v[:, order]
    v *= np.sign(v[np.abs(v).argmax(axis=0), np.arange(n)])
    return values[order], v


@dataclass
class Whitening:
    """What was fitted: the centre, components as columns, their standard deviations, and shares of the variance."""

    centre: Centre
    components: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centre(x) @ (self.components / self.deviations)


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, int]:
    """Rows (id, v) that can be fitted, and their dimension (0 if there are none)."""
    rows = vectors.select(F.col(vec_id).alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size("v") > 0))
    widths = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return (rows.filter(F.size("v") == widths["width"]), widths["width"]) if widths else (rows, 0)


def _blocks(batches: Iterator[pa.RecordBatch], width: int, column: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, len(batch), BLOCK):
            some = batch.slice(start, BLOCK)
            yield some, whole_numbers(some.column(column), width)


def centre(rows: DataFrame, width: int) -> Centre:
    """Count and exact sums: one row per task and dimension, added by Spark; as many rows as dimensions come back."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, high, low = 0, [0] * width, [0] * width
        for _, x in _blocks(batches, width):
            count += len(x)
            high = [a + b for a, b in zip(high, (x >> 32).sum(axis=0).tolist())]
            low = [a + b for a, b in zip(low, (x & 0xFFFFFFFF).sum(axis=0).tolist())]
        if count:
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([count] * width), pa.array(high), pa.array(low)], names=["dim", "n", "high", "low"])

    whole = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    sums = map_arrow(rows.select("v"), add, "dim int, n long, high long, low long").groupBy("dim").agg(F.sum("n").alias("n"), whole("high"), whole("low")).orderBy("dim").collect()
    return Centre(sums[0]["n"], [(int(r["high"]) << 32) + int(r["low"]) for r in sums])


def _one_row(number: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([r.ravel()], pa.list_(pa.float64()))], names=["number", "r"])


def factor(rows: DataFrame, width: int, middle: Centre) -> np.ndarray:
    """The triangle of all centred rows: one for each task, then one of every FANIN, until there is one."""

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = None
        for _, x in _blocks(batches, width):
            block = middle(x)
            r = triangle(block if r is None else np.vstack([r, block]))
        if r is not None:
            yield _one_row(TaskContext.get().partitionId(), r)

    def reduce_triangles(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            for some in batch.column("r").to_pylist():
                more = np.array(some).reshape(width, width)
                r = more if r is None else triangle(np.vstack([r, more]))
        yield _one_row(key[0].as_py(), r)

    schema = "number long, r array<double>"
    table = written(map_arrow(rows.select("v"), reduce_rows, schema), "triangles")
    while (last := table.agg(F.max("number")).first()[0]) > 0:
        groups = table.select(F.floor(F.col("number") / FANIN).alias("number"), "r")
        before, table = table, written(groups.groupBy("number").applyInArrow(reduce_triangles, schema), "triangles")
        drop_tables(before)
        if last < FANIN:
            break
    r = np.array(table.first()["r"]).reshape(width, width)
    drop_tables(table)
    return r


def fit(rows: DataFrame, width: int, most: int = 32) -> Whitening:
    """The centre and up to `most` components of the rows of usable()."""
    middle = centre(rows, width)
    values, vectors = jacobi(factor(rows, width, middle))
    spread = values / np.sqrt(middle.count)
    variance = spread**2
    kept = min(most, int((values > width * np.finfo(float).eps * values[0]).sum()))
    share = variance / variance.sum() if kept else variance
    return Whitening(middle, vectors[:, :kept], spread[:kept], share[:kept])


def identity_error(rows: DataFrame, width: int, fitted: Whitening) -> float:
    """The largest entry of the projected rows' covariance minus the identity, measured on all rows."""
    k, n = fitted.components.shape[1], fitted.centre.count

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for _, x in _blocks(batches, width):
            w = fitted.project(x)
            total += np.vstack([w.T @ w, w.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(range((k + 1) * k), pa.int32()), pa.array(total.ravel())], names=["place", "total"])

    sums = map_arrow(rows.select("v"), add, "place int, total double").groupBy("place").agg(F.sum("total").alias("total")).collect()
    total = np.zeros((k + 1) * k)
    total[[r["place"] for r in sums]] = [r["total"] for r in sums]
    total = total.reshape(k + 1, k) / n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", most: int = 32) -> DataFrame:
    """One row per remaining row and component: the id and the columns of SCHEMA."""
    kind = vectors.schema[vec_id].dataType.simpleString()
    rows, width = usable(vectors, vec_id, embedding)
    fitted = fit(rows, width, most) if width else None
    k = fitted.components.shape[1] if fitted else 0
    if not k:
        return vectors.sparkSession.createDataFrame([], f"`{vec_id}` {kind}, {SCHEMA}")
    error = identity_error(rows, width, fitted)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, x in _blocks(batches, width, 1):
            m = len(x)
            deviation = [d if d < 1 << 63 else None for d in fitted.centre.deviations(x)]
            each = np.repeat(np.arange(m), k)
            columns = [some.column(0).take(pa.array(each)), np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, fitted.centre.count), pa.array(deviation, pa.int64()).take(pa.array(each)), fitted.project(x).ravel(), np.tile(fitted.explained, m), np.full(m * k, error)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return map_arrow(rows.select("id", "v"), project, f"id {kind}, {SCHEMA}").withColumnRenamed("id", vec_id)
