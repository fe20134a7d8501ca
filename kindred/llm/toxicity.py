"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Features are whether a hashed character n-gram occurs in a text. Their log-count ratios r come from the labelled rows
of a sample; a logistic regression with an L2 penalty is then fitted on r-scaled features (Wang and Manning, 2012), by
mini-batches of a fixed order. The sample is a share of the labelled ids chosen by a hash, at most about `sample` of
them, and of an id that more than PER_ID rows share, about PER_ID different texts: these bounds are this classifier's
parameters. Every text is scored whole, however long: a text's features are a bitmap of 2 ** bits at most.

Definitions for odd input: null and empty texts get the score of a text without n-grams; rows whose label is null or
whose id has none are not learned from; an id with several labels has the largest; equal rows are learned from once;
rows with equal ids are scored each on its own; if one label is missing, the share of ones among the labels (0 if there
are no labels) is every score; a score that equals the threshold is toxic; an empty table gives an empty result; columns
besides those named are not read, so their names may clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.ngrams import buckets, code_points
from kindred.llm.shared import add_arrow, held_out, map_arrow, written

SIZES, BITS = (3, 4, 5, 6), 18
#: At most about so many labelled ids are learned from, and of each so many texts.
SAMPLE, PER_ID = 8000, 4
THRESHOLD = 0.7


def features(text: str | None, sizes: tuple[int, ...] = SIZES, bits: int = BITS) -> np.ndarray:
    """The distinct buckets of a text's n-grams, ascending."""
    found = np.zeros(1 << bits, bool)
    points = code_points(text)
    for n in sizes:
        found[buckets(points, (n,), bits)] = True
    return np.flatnonzero(found).astype(np.int32)


def packed(x: np.ndarray) -> bytes:
    """Ascending buckets as compressed differences, a third of their size or less."""
    return zlib.compress(np.diff(x, prepend=np.int32(0)).astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


class Packed(Sequence):
    """Rows of buckets that stay packed until they are read."""

    def __init__(self, rows: list[bytes]) -> None:
        self.rows = rows

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i: int) -> np.ndarray:
        planes = np.frombuffer(zlib.decompress(self.rows[i]), np.uint8).reshape(4, -1)
        return np.cumsum(np.ascontiguousarray(planes.T).view("<i4").ravel(), dtype=np.int32)


def margins(rows: list[np.ndarray], w: np.ndarray) -> np.ndarray:
    return np.array([w[x].sum() / np.sqrt(max(len(x), 1)) for x in rows], np.float64)


def fit(rows: Sequence[np.ndarray], labels: np.ndarray, bits: int = BITS, rounds: int = 5, penalty: float = 1e-4, rate: float = 0.05, least: int = 3) -> tuple[np.ndarray, float]:
    """Weights (of unscaled features) and intercept.

    Features of fewer than `least` rows are left out. Every fourth row is kept from the regression and sets the slope
    and the intercept of the scores, and what a text's length adds (Platt's scaling, both labels weighing alike).
    """
    ones = int(labels.sum())
    kept = np.arange(len(rows)) % 4 == 3
    if len(rows) < 40 or min(labels[kept].sum(), kept.sum() - labels[kept].sum()) < 3:
        kept[:] = False
    learned = np.flatnonzero(~kept)
    if not len(rows) or ones in (0, len(rows)):
        share = min(max(ones / len(rows), 1e-6), 1 - 1e-6) if len(rows) else 1e-6
        return np.zeros(1 << bits, np.float32), float(np.log(share / (1 - share)))
    count = [np.ones(1 << bits), np.ones(1 << bits)]
    for i in learned:
        count[int(labels[i])][rows[i]] += 1
    n1 = int(labels[learned].sum())
    n0 = len(learned) - n1
    ratio = (np.log(count[1] / (n1 + 2)) - np.log(count[0] / (n0 + 2))).astype(np.float32)
    if len(rows) >= 400:
        ratio[count[0] + count[1] - 2 < least] = 0
    w = np.zeros(1 << bits, np.float32)
    past = np.full(1 << bits, 1e-2, np.float32)  # Adagrad: steps are small where gradients have been large
    bias, bias_past = 0.0, 1e-2
    balance = (0.5 * len(learned) / n0, 0.5 * len(learned) / n1)
    order = np.random.default_rng(17)
    for _ in range(rounds):
        for i in order.permutation(learned):
            x, y = rows[i], int(labels[i])
            values = ratio[x] / np.sqrt(max(len(x), 1))  # texts of all lengths weigh alike
            g = (1.0 / (1.0 + np.exp(-(float(w[x] @ values) + bias))) - y) * balance[y]
            step = np.float32(g) * values + np.float32(penalty) * w[x]
            past[x] += step * step
            w[x] -= rate * step / np.sqrt(past[x])
            bias_past += g * g
            bias -= rate * g / np.sqrt(bias_past)
    w *= ratio
    if kept.any():
        some = [rows[i] for i in np.flatnonzero(kept)]
        slope, shift, bias = _scaled(margins(some, w), np.sqrt([max(len(x), 1) for x in some]), labels[kept])
        w = w * np.float32(slope) + np.float32(shift)  # adds shift times the root of a text's features to its margin
    return w, bias


def _scaled(x: np.ndarray, root: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Coefficients of margins and of roots of lengths, and intercept, of a logistic regression; targets are drawn in as Platt does."""
    ones, zeros = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    weight = np.where(y == 1, 0.5 / ones, 0.5 / zeros)
    spread, wide = x.std() + 1e-9, root.std() + 1e-9
    z = np.stack([(x - x.mean()) / spread, (root - root.mean()) / wide, np.ones(len(x))])
    a = np.zeros(3)
    ridge = np.array([1e-4, 1e-3, 0])
    for _ in range(80):
        p = 1 / (1 + np.exp(-np.clip(a @ z, -35, 35)))
        hessian = (z * (weight * p * (1 - p))) @ z.T + np.diag(ridge + 1e-9)
        a -= np.clip(np.linalg.solve(hessian, z @ (weight * (p - t)) + ridge * a), -2, 2)
    slope, shift = max(a[0], 1e-3) / spread, a[1] / wide
    return float(slope), float(shift), float(a[2] - slope * x.mean() - shift * root.mean())


def sampled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, sample: int, fold: bool) -> DataFrame:
    """id, text and label of the rows that are learned from (with fold: only those that are not held out)."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("id").isNotNull())
    if fold:
        known = known.filter(~held_out("id"))
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    share = min(1.0, sample / max(known.count(), 1))
    chosen = known.filter(F.pmod(F.xxhash64("id", F.lit(23)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    # about `sample` ids go to the texts, which stay where they are; an id that many rows share is thinned by its texts
    found = written(rows.select("id").join(F.broadcast(chosen), "id").groupBy("id", "label").count(), "labelled")
    few = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) * F.col("count") < F.lit(PER_ID << 20)
    return rows.join(F.broadcast(found), "id").filter(few).select("id", "text", "label").dropDuplicates(["id", "text"])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, fold: bool = True) -> tuple[np.ndarray, float]:
    """Fit on labelled rows (with fold: only those that are not held out); one task gets the bounded sample."""
    texts = sampled(docs, labels, doc_id, text, label, sample, fold)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [packed(features(x.as_py())) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(2), pa.array(found, pa.binary())], names=["id", "label", "features"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        w, bias = fit(Packed([x for _, _, x in rows]), np.array([y for _, y, _ in rows], np.int64))
        yield pa.RecordBatch.from_pydict({"weights": [w.astype("<f4").tobytes()], "bias": [bias]})

    found = map_arrow(texts, extract, "id string, label int, features binary")
    row = map_arrow(found.repartition(1), learn, "weights binary, bias double").first()
    return np.frombuffer(row["weights"], "<f4"), row["bias"]


def with_score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", name: str = "score") -> DataFrame:
    """Add the score; texts go to Python once, and only scores come back."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB, whatever the corpus

    def work(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w, bias = shared.value
        for batch in texts:
            values = [w[x].sum(dtype=np.float64) / np.sqrt(max(len(x), 1)) + bias for x in (features(t.as_py()) for t in batch)]
            yield pa.array(1 / (1 + np.exp(-np.clip(np.array(values, np.float64), -500, 500))), pa.float64())

    return add_arrow(docs, name, work, "double", F.col(text).cast("string"))


def score(docs: DataFrame, model: tuple[np.ndarray, float], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id and score."""
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    return with_score(rows, model, "_text").select(F.col("_id").alias(doc_id), "score")


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """One row per document: its id, held_out, score, predicted."""
    scored = score(docs, train(docs, labels, doc_id, text, label, sample), doc_id, text)
    return scored.select(doc_id, F.coalesce(held_out(doc_id), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
