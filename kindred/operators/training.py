"""Training of the pair MLP in distributed mini-batches, with checkpoints that a later run goes on from.

Pairs are dealt to batches by a hash of their ids and written once, a folder for each batch, rows in order. A step reads one
batch: each task adds up the gradient of its rows, tasks' sums are added by groups of FANIN, and the driver gets those few
rows, clips the gradient's length and takes a step of AdamW. Order and grouping are fixed by ids and files, so a run that is
cut and resumed does what an uncut one does. The loss is cross-entropy; positives weigh negatives / positives of the batch,
and a batch without positives is passed over.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.operators.score import PairMLP
from kindred.storage import path_exists, scratch

#: Tasks whose gradients are added up by one.
FANIN = 16


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1) if len(vectors) else np.empty((0, 1))


def gradient(model: PairMLP, a: np.ndarray, b: np.ndarray, target: np.ndarray, positive_weight: float) -> tuple[float, np.ndarray]:
    """The sums over rows of the loss and of its gradient, all weights in one row."""
    inputs, slopes = [np.abs(a - b)], []
    for i, (w, bias) in enumerate(model.layers):
        z = inputs[-1] @ w + bias
        if i + 1 < len(model.layers):
            c = math.sqrt(2 / math.pi)
            t = np.tanh(c * (z + 0.044715 * z**3))
            slopes.append(0.5 * (1 + t) + 0.5 * z * (1 - t * t) * c * (1 + 3 * 0.044715 * z * z))
            inputs.append(0.5 * z * (1 + t))
    z = z[:, 0]
    weight = np.where(target == 1, positive_weight, 1.0)
    loss = float((weight * np.logaddexp(0, np.where(target == 1, -z, z))).sum())
    back = (weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - target))[:, None]
    parts: list[np.ndarray] = []
    for i in range(len(model.layers) - 1, -1, -1):
        parts = [(inputs[i].T @ back).ravel(), back.sum(axis=0), *parts]
        if i:
            back = (back @ model.layers[i][0].T) * slopes[i - 1]
    return loss, np.concatenate(parts)


def flat(layers: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    return np.concatenate([x.ravel() for layer in layers for x in layer])


def shaped(row: np.ndarray, like: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for layer in like:
        pair = []
        for x in layer:
            pair.append(row[at : at + x.size].reshape(x.shape).copy())
            at += x.size
        out.append(tuple(pair))
    return out


@dataclass
class State:
    """What a checkpoint holds: the weights in one row, AdamW's means, the number of steps taken, and the loss of each."""

    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray
    step: int = 0
    taken: int = 0
    losses: list[float] = field(default_factory=list)

    def save(self, spark: SparkSession, folder: str) -> str:
        path = f"{folder}/step-{self.step:08d}"
        row = (self.step, self.taken, *[x.tolist() for x in (self.weights, self.first, self.second)], self.losses)
        spark.createDataFrame([row], "step long, taken long, weights array<double>, first array<double>, second array<double>, losses array<double>").coalesce(1).write.mode("overwrite").parquet(path)
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> State:
        r = spark.read.parquet(path).first()
        return cls(*[np.array(r[c]) for c in ("weights", "first", "second")], r["step"], r["taken"], list(r["losses"]))


def latest(spark: SparkSession, folder: str) -> str | None:
    """The checkpoint of the most steps that was written whole."""
    if not path_exists(spark, folder):
        return None
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = sorted(f.getPath().getName() for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path))
    done = [n for n in names if n.startswith("step-") and path_exists(spark, f"{folder}/{n}/_SUCCESS")]
    return f"{folder}/{done[-1]}" if done else None


@dataclass
class Batches:
    """Pairs in folders by batch, and how many positives and pairs each has."""

    folder: str
    counts: list[tuple[int, int]]

    @classmethod
    def write(cls, pairs: DataFrame, column: str, size: int, seed: int = 0, parts: int = 1) -> Batches:
        """pairs: left_id, right_id, target, and the vectors' left_ and right_ columns; pairs without a vector are left out.
        parts: how many tasks read one batch."""
        spark = pairs.sparkSession
        a, b = f"left_{column}", f"right_{column}"
        rows = pairs.select("left_id", "right_id", F.col("target").cast("int").alias("target"), F.col(a).cast("array<double>").alias("a"), F.col(b).cast("array<double>").alias("b")).filter("a is not null and b is not null and target is not null")
        number = max(1, -(-rows.count() // size))
        key = F.xxhash64("left_id", "right_id", F.lit(seed))
        dealt = rows.withColumn("batch", F.pmod(key, F.lit(number))).withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)))
        folder = scratch(spark, "training-batches")
        dealt.repartition("batch", "part").sortWithinPartitions("batch", "part", "left_id", "right_id").write.partitionBy("batch", "part").parquet(folder)
        counts = [(0, 0)] * number
        for r in spark.read.parquet(folder).groupBy("batch").agg(F.sum("target").alias("p"), F.count(F.lit(1)).alias("n")).collect():  # a row a batch
            counts[r["batch"]] = (r["p"], r["n"])
        return cls(folder, counts)

    def read(self, spark: SparkSession, number: int) -> DataFrame:
        schema = "target int, a array<double>, b array<double>, part int"
        return spark.read.schema(schema).option("basePath", f"{self.folder}/batch={number}").parquet(f"{self.folder}/batch={number}")


def batch_gradient(rows: DataFrame, model: PairMLP, positive_weight: float) -> tuple[float, np.ndarray]:
    """Sums of loss and gradient over a batch (target, a, b)."""
    size = flat(model.layers).size

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        loss, total, n = 0.0, np.zeros(size), 0
        for batch in batches:
            own, grad = gradient(model, _matrix(batch.column(1)), _matrix(batch.column(2)), batch.column(0).to_numpy(), positive_weight)
            loss, total, n = loss + own, total + grad, n + len(batch)
        if n:
            yield _row(TaskContext.get().partitionId(), loss, total)

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["part"])
        yield _row(key[0].as_py(), sum(r["loss"] for r in found), sum((np.array(r["total"]) for r in found), np.zeros(size)))

    schema = "part long, loss double, total array<double>"
    sums = rows.select("target", "a", "b").mapInArrow(add, schema)
    found = sums.groupBy(F.expr(f"part div {FANIN}").alias("g")).applyInArrow(merge, schema).orderBy("part").collect()  # a row for FANIN tasks
    return sum(r["loss"] for r in found), sum((np.array(r["total"]) for r in found), np.zeros(size))


def _row(part: int, loss: float, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([loss]), pa.array([total], pa.list_(pa.float64()))], names=["part", "loss", "total"])


def train(model: PairMLP, batches: Batches, spark: SparkSession, steps: int, rate: float = 1e-3, decay: float = 0.0, clip: float = 1.0, betas: tuple[float, float] = (0.9, 0.999), folder: str | None = None, every: int = 10, resume: bool = True) -> tuple[PairMLP, State]:
    """Steps of AdamW up to the given number in all; batches are taken in turn.

    folder: where checkpoints go, every so many steps and at the end; with resume, the latest one there is gone on from.
    Returns the model and the state, whose losses are means over each step's batch.
    """
    start = flat(model.layers)
    state = State(start, np.zeros_like(start), np.zeros_like(start))
    if folder and resume and (path := latest(spark, folder)):
        state = State.load(spark, path)
        if state.weights.size != start.size:
            raise ValueError(f"the checkpoint {path} is of another network")
    while state.step < steps:
        number = state.step % len(batches.counts)
        positives, n = batches.counts[number]
        state.step += 1
        if positives:
            now = PairMLP(shaped(state.weights, model.layers), model.column)
            loss, grad = batch_gradient(batches.read(spark, number), now, (n - positives) / positives)
            grad = grad / n
            length = float(np.sqrt((grad * grad).sum()))
            grad *= min(1.0, clip / (length + 1e-6))
            state.taken += 1
            state.first = betas[0] * state.first + (1 - betas[0]) * grad
            state.second = betas[1] * state.second + (1 - betas[1]) * grad * grad
            mean, square = state.first / (1 - betas[0] ** state.taken), state.second / (1 - betas[1] ** state.taken)
            state.weights = state.weights * (1 - rate * decay) - rate * mean / (np.sqrt(square) + 1e-8)
            state.losses.append(loss / n)
        if folder and (state.step % every == 0 or state.step == steps):
            state.save(spark, folder)
    return PairMLP(shaped(state.weights, model.layers), model.column), state


def falls(losses: Sequence[float]) -> bool:
    """True if the last quarter's mean loss is below the first's."""
    k = max(1, len(losses) // 4)
    return len(losses) > 1 and float(np.mean(losses[-k:])) < float(np.mean(losses[:k]))


def improved(before: PairMLP, after: PairMLP, batches: Batches, spark: SparkSession, steps: int) -> bool:
    """True if the mean loss of the batches that so many steps took is lower with the second model. Both see the same batches:
    the losses of steps are each of another batch, and differ by more than a few steps change."""
    sums = np.zeros(2)
    for number, (positives, n) in enumerate(batches.counts[:steps]):
        if positives:
            rows = batches.read(spark, number)
            sums += [batch_gradient(rows, model, (n - positives) / positives)[0] / n for model in (before, after)]
    return bool(sums[1] < sums[0])
