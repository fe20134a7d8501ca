"""Best rows of a small side by TF-IDF of words' n-grams, where the other side's texts are: each task reads the small side's
index from the shared folder and scores its texts one by one, so no n-gram of the large side is a row.

N-grams are known by 64-bit hashes of their characters, which are made of a whole text at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import dataset
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.storage import open_fs, scratch

#: The largest index that a task holds: cells (n-grams of rows) and rows. Beyond either, simjoin.top_k joins instead.
MOST_CELLS, MOST_ROWS = 2_000_000, 4096

_WORD = re.compile("[^ \t\n\x0b\f\r]+")  # as the separators of pairs.char_grams
#: The same in every task.
_FACTORS = np.random.default_rng(11).integers(1 << 62, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def _hashes(points: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n characters in a row."""
    places = max(0, len(points) - n + 1)
    out = np.full(places, n, np.uint64)
    for j in range(n):
        out += points[j : j + places] * _FACTORS[j % len(_FACTORS)] * np.uint64(2 * (j // len(_FACTORS)) + 1)
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


def text_hashes(text: str, sizes: tuple[int, ...]) -> np.ndarray:
    """Hashes of the n-grams that pairs.char_grams has of a lower-cased text, repeats included."""
    points = _points(f" {' '.join(_WORD.findall(text))} ")
    space = points == 32
    before = np.concatenate([[0], np.cumsum(space)])
    found = []
    for n in range(3, max(sizes) + 1):
        if n in sizes or n < min(sizes):
            places = max(0, len(points) - n + 1)
            fine = before[n - 1 : n - 1 + places] == before[1 : 1 + places]  # no space but at the ends
            if n < min(sizes):  # a word shorter than all sizes counts whole
                fine &= space[:places] & space[n - 1 : n - 1 + places]
            found.append(_hashes(points, n)[fine])
    return np.concatenate(found)


class _Index:
    def __init__(self, path: str, sizes: tuple[int, ...]) -> None:
        system, place = open_fs(path)
        table = dataset.dataset(place, filesystem=system, format="parquet").to_table()
        grams, ids = (table.column(c).combine_chunks().dictionary_encode() for c in ("gram", "right_id"))
        self.sizes, self.ids = sizes, ids.dictionary
        # ids in order, as ties go by them
        self.order = np.argsort(np.argsort(self.ids.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
        hashes = np.array([_hashes(p := _points(g), len(p))[0] for g in grams.dictionary.to_pylist()], np.uint64)
        hashes, rows = hashes[grams.indices.to_numpy()], ids.indices.to_numpy()
        # cells by n-gram and id, so that sums don't depend on the order of files
        cells = np.lexsort((self.order[rows], hashes))
        self.grams, self.starts = np.unique(hashes[cells], return_index=True)
        self.lengths = np.diff(np.append(self.starts, len(cells)))
        self.rows, self.weights = rows[cells], table.column("w").to_numpy()[cells]
        self.idf = table.column("idf").to_numpy()[cells][self.starts]

    def scores(self, text: str) -> np.ndarray | None:
        """The cosine with each row; None if no n-gram is known."""
        hashes = np.sort(text_hashes(text, self.sizes))
        if not len(hashes) or not len(self.grams):
            return None
        starts = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        own, counts = hashes[starts], np.diff(np.append(starts, len(hashes)))
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        known = self.grams[at] == own
        at, counts = at[known], counts[known]
        if not len(at):
            return None
        weights, lengths = counts * self.idf[at], self.lengths[at]
        ends = np.cumsum(lengths)
        cells = np.arange(ends[-1]) + np.repeat(self.starts[at] - ends + lengths, lengths)
        return np.bincount(self.rows[cells], self.weights[cells] * np.repeat(weights, lengths), len(self.ids)) / np.sqrt(weights @ weights)

    def best(self, text: str, k: int, digits: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best rows with a score above 0."""
        score = self.scores(text)
        if score is None:
            return np.zeros(0, np.int64), np.zeros(0)
        rounded = np.floor(score * 10**digits + 0.5)
        near = np.flatnonzero(score > 0)
        if len(near) > k:
            near = near[rounded[near] >= np.partition(rounded[near], len(near) - k)[len(near) - k]]
        best = near[np.lexsort((self.order[near], -rounded[near]))[:k]]
        return best, score[best]


def best_rows(texts: DataFrame, index: DataFrame, k: int, sizes: tuple[int, ...], digits: int = 9) -> DataFrame:
    """left_id, right_id, rank, score. texts: left_id and t, lower-cased; index: right_id, gram, w (of length one), idf."""
    path = scratch(texts.sparkSession, "gram-index")
    index.select("right_id", "gram", "w", "idf").write.parquet(path)
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((texts, "left_id"), (index, "right_id"))}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = None
        for batch in batches:
            there = there or _Index(path, sizes)
            found = [there.best(t, k, digits) for t in batch.column(1).to_pylist()]
            n = [len(at) for at, _ in found]
            if sum(n):
                at, score = (np.concatenate(x) for x in zip(*found))
                rank = np.concatenate([np.arange(1, m + 1, dtype=np.int32) for m in n])
                left = batch.column(0).take(pa.array(np.repeat(np.arange(len(n)), n)))
                yield pa.RecordBatch.from_arrays([left, there.ids.take(pa.array(at)), pa.array(rank), pa.array(score)], names=["left_id", "right_id", "rank", "score"])

    rows = texts.select("left_id", "t").filter("left_id is not null and t is not null")
    tasks = texts.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < tasks:  # a small file is one task's
        rows = rows.repartition(tasks)
    return rows.mapInArrow(work, f"left_id {kinds['left_id']}, right_id {kinds['right_id']}, rank int, score double")


def one_text_an_id(texts: DataFrame) -> DataFrame:
    """(left_id, t) with texts of one id put together; only ids that several rows have are shuffled with their texts."""
    several = texts.groupBy("left_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("left_id")
    if several.isEmpty():
        return texts
    merged = texts.join(several, "left_id", "left_semi").groupBy("left_id").agg(F.concat_ws(" ", F.collect_list("t")).alias("t"))
    return texts.join(several, "left_id", "left_anti").unionByName(merged)
