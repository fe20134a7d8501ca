"""Nearest neighbours and top pairs of vectors by cosine, from an index of cells.

Centroids are fitted on a bounded sample of unit vectors; every vector is put into the cell of its nearest centroid. A query
visits its nearest cells, whose vectors are compared exactly. In exact mode it then visits each further cell that may hold
a better neighbour: if a centroid is at the angle a and no vector of its cell further from it than r, no vector of the
cell is nearer than a - r. Cells, and the queries that visit one, are dealt in chunks of CHUNK, so that no task grows with a
cell; equal vectors are one member of the index, with their smallest ids, so that copies are no work.

For top pairs, near cells make groups, and groups meet in tiles: first each with itself, whose best pairs bound the rest, then
those that have cells which can hold a better pair; in a tile, only vectors meet cells by the same bound. Vectors that don't
cluster are all compared, which grows with the square of their number; a tile multiplies in single precision, and only what
that can't rule out is scored in double.

Scores are rounded to `digits`, and ties are broken by ids. Rows whose vector is null, zero, or holds an entry that is null
or not finite have no neighbours and are none; vectors must be of one length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.storage import written

#: Vectors that centroids are fitted on, and the most cells there are: what goes to all tasks is bounded by their product
#: with the dimension (4 MB for cells of 128 entries).
SAMPLE, CELLS = 20_000, 4096
#: Vectors of a cell, and queries that visit it, that are compared in one go.
CHUNK = 4096
#: Most vectors of a group, two of which make a tile; vectors of a packed row; rows and columns that are multiplied in one go.
GROUP, PACK, SLICE = 32_768, 2048, 1024
#: Parts that the rows of one vector are numbered in before they meet.
_PARTS = 64


def usable(records: DataFrame, record_id: str, vector: str) -> DataFrame:
    """Rows (id, v) that the index takes, v of length one."""
    kind = records.schema[record_id].dataType.simpleString()
    rows = records.select(F.col(record_id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = _matrix(batch.column(1))
                # divided by the largest entry first, so that squares neither overflow nor vanish
                x = _unit(x / np.abs(x).max(axis=1, keepdims=True))
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists(x)], names=["id", "v"])

    return rows.filter(F.col("id").isNotNull() & fine & F.exists("v", lambda x: x != 0)).mapInArrow(scale, f"id {kind}, v array<double>")


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))


def members(rows: DataFrame, k: int) -> DataFrame:
    """One row per distinct vector: id (the smallest of its rows), v, ids (the smallest k of them)."""
    part = F.pmod(F.xxhash64("id"), F.lit(_PARTS))
    first = rows.withColumn("at", F.row_number().over(Window.partitionBy("v", part).orderBy("id"))).filter(F.col("at") <= k)
    return first.groupBy("v").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k).alias("ids")).select(F.element_at("ids", 1).alias("id"), "v", "ids")


def _matrix(vectors: pa.Array) -> np.ndarray:
    if pa.types.is_fixed_size_list(vectors.type):
        return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
    lengths = pc.list_value_length(vectors).to_numpy()
    if len(lengths) and (lengths != lengths[0]).any():
        raise ValueError("the vectors differ in length")
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(size == 0, 1, size)


def spherical_means(x: np.ndarray, cells: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Centroids of unit vectors: each moves to the mean of those nearest to it; one that has none, to the worst served."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), cells, replace=False)]
    for _ in range(rounds):
        similar = x @ centroids.T
        nearest = similar.argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        empty = np.bincount(nearest, minlength=cells) == 0
        sums[empty] = x[np.argsort(similar.max(axis=1))[: empty.sum()]]
        centroids = _unit(sums)
    return centroids


@dataclass
class Index:
    """Centroids, how many cells a query visits, the members (cell, id, v, ids) and, by cell, their number and largest angle."""

    centroids: np.ndarray
    visit: int
    members: DataFrame
    sizes: np.ndarray
    radius: np.ndarray
    k: int
    digits: int

    def _compared(self, visits: DataFrame, kind: str) -> DataFrame:
        """query, id, score: the k + 1 best members for each query in each chunk that it visits. visits: cell, query, q."""
        asked = visits.groupBy("cell").count().collect()  # a row a cell at most
        queries = np.zeros(len(self.sizes), np.int64)
        queries[[r["cell"] for r in asked]] = [r["count"] for r in asked]
        chunks = lambda n: np.maximum(1, -(-n // CHUNK)).tolist()
        by_cell = lambda n: F.element_at(F.array(*map(F.lit, chunks(n))), F.col("cell") + 1) if max(chunks(n)) > 1 else F.lit(1)
        m, q = by_cell(self.sizes), by_cell(queries)
        own = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), n.cast("int") - 1))
        left = visits.withColumn("b", own("query", q)).withColumn("a", every(m))
        right = self.members.select("cell", "id", "v").filter(F.col("cell").isin([r["cell"] for r in asked]) if len(asked) < len(self.sizes) else F.lit(True)).withColumn("a", own("id", m)).withColumn("b", every(q))
        k, scale = self.k + 1, 10**self.digits

        def compare(key: tuple, asked: pa.Table, there: pa.Table) -> pa.Table:
            found: list[pa.Table] = []
            if len(there) and len(asked):
                there = there.sort_by("id")
                ids, x = there.column("id").combine_chunks(), _matrix(there.column("v").combine_chunks())
                names = asked.column("query").combine_chunks()
                for start in range(0, len(asked), 512):
                    some = asked.slice(start, 512)
                    score = _matrix(some.column("q").combine_chunks()) @ x.T
                    # larger scores first, then smaller ids: one number for both
                    order = np.round(score * scale).astype(np.int64) * len(ids) - np.arange(len(ids))
                    best = np.argpartition(-order, k - 1, axis=1)[:, :k] if len(ids) > k else np.tile(np.arange(len(ids)), (len(some), 1))
                    row = np.repeat(np.arange(len(some)), best.shape[1])
                    at = best.ravel()
                    found.append(pa.table({"query": names.take(pa.array(start + row)), "id": ids.take(pa.array(at)), "score": score[row, at]}))
            return pa.concat_tables(found) if found else pa.table({"query": asked.column("query").slice(0, 0), "id": asked.column("query").slice(0, 0), "score": pa.array([], pa.float64())})

        key = ["cell", "a", "b"]
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compare, f"query {kind}, id {kind}, score double")

    def _cells(self, queries: DataFrame, kind: str, exact: bool) -> DataFrame:
        """query, q, cell: the nearest cells of queries (id, v), or those beyond them that may hold a score of `least` or more."""
        centroids, radius, there, visit, slack = self.centroids, self.radius, self.sizes > 0, self.visit, 10.0**-self.digits

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches if there.any() else ():
                for start in range(0, len(batch), 1024):
                    some = batch.slice(start, 1024)
                    similar = np.clip(_matrix(some.column(1)) @ centroids.T, -1, 1)
                    similar[:, ~there] = -2
                    order = np.argsort(-similar, axis=1, kind="stable")
                    chosen = np.zeros(similar.shape, bool)
                    np.put_along_axis(chosen, order[:, :visit], True, axis=1)
                    if exact:
                        bound = np.cos(np.maximum(np.arccos(np.clip(similar, -1, 1)) - radius - 1e-9, 0))
                        chosen = ~chosen & (bound >= some.column(2).to_numpy()[:, None] - slack)
                    row, cell = np.nonzero(chosen & there)
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([some.column(0).take(take), some.column(1).take(take), pa.array(cell.astype(np.int32))], names=["query", "q", "cell"])

        rows = queries.select("id", "v", *["least"] * exact)
        return rows.mapInArrow(work, f"query {kind}, q array<double>, cell int")

    def _best(self, found: DataFrame, k: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.round("score", self.digits).desc(), "id"))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k)

    def search(self, queries: DataFrame, record_id: str, vector: str, exact: bool = False) -> DataFrame:
        """query_index, neighbor_index, rank, score: the k best members of the index for each query, itself left out."""
        kind = queries.schema[record_id].dataType.simpleString()
        rows = written(usable(queries, record_id, vector), "queries")
        asked = written(members(rows, 1).select("id", "v"), "distinct-queries")
        found = written(self._best(self._compared(self._cells(asked, kind, False), kind), self.k + 1), "neighbours")
        if exact:
            least = found.groupBy("query").agg(F.when(F.count(F.lit(1)) > self.k, F.min("score")).otherwise(-1.0).alias("least"))
            beyond = asked.join(least, asked["id"] == least["query"], "left").select("id", "v", F.coalesce("least", F.lit(-1.0)).alias("least"))
            more = self._compared(written(self._cells(beyond, kind, True), "visits"), kind)
            found = written(self._best(found.drop("rank").unionByName(more), self.k + 1), "neighbours")
        # members stand for their ids; a query drops itself, and gets k of at most (k + 1) ** 2
        named = found.drop("rank").join(self.members.select("id", "ids"), "id").select("query", "score", F.explode("ids").alias("id"))
        best = self._best(named, self.k + 1).groupBy(F.col("query").alias("class")).agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("best"))
        of = rows.join(asked.withColumnRenamed("id", "class"), "v").select("id", "class").join(best, "class")
        others = F.slice(F.filter("best", lambda x: x["id"] != F.col("id")), 1, self.k)
        return of.select(F.col("id").alias("query_index"), F.posexplode(others).alias("at", "x")).select("query_index", F.col("x.id").alias("neighbor_index"), (F.col("at") + 1).alias("rank"), F.round("x.score", self.digits).alias("score"))

    def top_pairs(self, k: int) -> DataFrame:
        """left_index, right_index, score of the k best pairs of the index's rows; the index must have been made for as many
        neighbours. A pair among the k best is among either end's k best, or is as good as those."""
        if k > self.k:
            raise ValueError(f"the index holds {self.k} ids of a vector, and {k} pairs are asked for")
        groups, near = self._grouped()
        found = written(self._met(groups, [(g, g) for g in range(len(near))], k, -1.0), "neighbours")

        def best(found: DataFrame) -> DataFrame:
            ends = [self.members.select(F.col("id").alias(c), F.col("ids").alias(f"{c}s")) for c in ("query", "id")]
            pairs = found.filter(F.col("query") < F.col("id")).unionByName(found.filter(F.col("query") > F.col("id")).select(F.col("id").alias("query"), F.col("query").alias("id"), "score")).distinct()
            pairs = pairs.orderBy(F.round("score", self.digits).desc(), "query", "id")
            across = pairs.limit(4 * k * (k + 1)).join(ends[0], "query").join(ends[1], "id").select("score", F.explode("querys").alias("a"), "ids").select("score", "a", F.explode("ids").alias("b"))
            own = self.members.filter(F.size("ids") > 1).select(F.lit(1.0).alias("score"), "ids", F.explode("ids").alias("a")).select("score", "a", F.explode("ids").alias("b")).filter("a < b")
            both = across.unionByName(own).select(F.least("a", "b").alias("left_index"), F.greatest("a", "b").alias("right_index"), F.round("score", self.digits).alias("score")).distinct()
            return both.orderBy(F.desc("score"), "left_index", "right_index").limit(k)

        first = best(found).collect()  # k rows
        least = first[-1]["score"] if len(first) == k else -1.0
        return best(found.unionByName(self._met(groups, self._tiles(near, least), k, least)))

    def _grouped(self) -> tuple[DataFrame, np.ndarray]:
        """Packed members (_g, ids, cells, v) of groups of near cells, and which cells each group has vectors of."""
        kind, n = self.members.schema["id"].dataType.simpleString(), int(self.sizes.sum())
        per = max(SLICE, min(GROUP, -(-n // 16)))
        order, left = [0], np.ones(len(self.sizes), bool)
        for _ in range(len(self.sizes) - 1):  # the nearest cell that is left comes next
            left[order[-1]] = False
            order.append(int(np.where(left, self.centroids @ self.centroids[order[-1]], -np.inf).argmax()))
        start = np.zeros(len(self.sizes), np.int64)
        start[order] = np.concatenate([[0], np.cumsum(self.sizes[order])[:-1]])
        sizes, near = self.sizes, np.zeros((-(-n // per), len(self.sizes)), bool)
        for c in np.flatnonzero(self.sizes):
            near[start[c] // per : (start[c] + self.sizes[c] - 1) // per + 1, c] = True

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell, share = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                group = np.minimum(start[cell] + (sizes[cell] * share).astype(np.int64), start[cell] + sizes[cell] - 1) // per
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(group.astype(np.int32))], names=["id", "v", "cell", "_g"])

        def pack(table: pa.Table) -> pa.Table:
            whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            x = _matrix(table.column("v").combine_chunks())
            return pa.table({"_g": table.column("_g").slice(0, 1), "ids": whole(table.column("id").combine_chunks()), "cells": whole(table.column("cell").combine_chunks()), "v": whole(pa.array(x.ravel()))})

        share = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
        rows = self.members.select("id", "v", "cell", share.alias("share")).mapInArrow(place, f"id {kind}, v array<double>, cell int, _g int")
        part = F.pmod(F.xxhash64("id", F.lit(8)), F.lit(-(-per // PACK)))
        return written(rows.groupBy("_g", part).applyInArrow(pack, f"_g int, ids array<{kind}>, cells array<int>, v array<double>"), "groups"), near

    def _tiles(self, near: np.ndarray, least: float) -> list[tuple[int, int]]:
        """Pairs of groups that have cells which can hold a pair of the score `least` or more."""
        hold, some = np.zeros((len(near), len(near))), near.astype(float)
        for i in range(0, len(self.sizes), 512):
            angle = np.arccos(np.clip(self.centroids[i : i + 512] @ self.centroids.T, -1, 1))
            bound = np.cos(np.maximum(angle - self.radius[i : i + 512, None] - self.radius - 1e-8, 0))
            hold += some[:, i : i + 512] @ (bound >= least - 10.0**-self.digits) @ some.T
        return [(int(a), int(b)) for a, b in np.argwhere(hold > 0) if a < b]

    def _met(self, groups: DataFrame, tiles: list[tuple[int, int]], k: int, least: float) -> DataFrame:
        """query, id, score: the best k pairs of members of each tile that score `least` or more; the query's id is the smaller."""
        kind = self.members.schema["id"].dataType.simpleString()
        centroids, radius, digits, scale = self.centroids, self.radius, self.digits, 10**self.digits
        # what rounding to single precision and to digits may add
        slack = (centroids.shape[1] + 4) * 6e-8 + 10.0**-digits

        def unpack(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
            ids, cells, v = (table.column(c).combine_chunks().flatten() for c in ("ids", "cells", "v"))
            cells = cells.to_numpy()
            order = np.argsort(cells, kind="stable")
            return ids.take(pa.array(order)), cells[order], v.to_numpy().reshape(len(cells), -1)[order]

        def tile(key: tuple, both: pa.Table) -> pa.Table:
            first, same = both.column("_first"), key[0].as_py() == key[1].as_py()
            ids, _, x = unpack(both.filter(first))
            others, cells, y = (ids, _, x) if same else unpack(both.filter(pc.invert(first)))
            names = pa.concat_arrays([ids, others])
            rank = pc.rank(names, tiebreaker="min").to_numpy().astype(np.int64)
            x4, y4, floor = x.astype(np.float32), y.astype(np.float32), least
            there, starts = np.unique(cells, return_index=True)
            bound = np.empty((len(x), len(there)), bool)
            for i in range(0, len(x), SLICE):
                angle = np.arccos(np.clip(x[i : i + SLICE] @ centroids[there].T, -1, 1))
                bound[i : i + SLICE] = np.cos(np.maximum(angle - radius[there] - 1e-8, 0)) >= least - slack
            kept = np.empty((0, 5), np.int64)  # minus rounded score, smaller and larger rank, row, column
            for j in range(0, len(y), SLICE):
                last = min(j + SLICE, len(y))
                rows = np.flatnonzero(bound[:, np.searchsorted(starts, j, "right") - 1 : np.searchsorted(starts, last, "left")].any(axis=1))
                rows = rows[rows < last] if same else rows
                for i in range(0, len(rows), SLICE):
                    some = rows[i : i + SLICE]
                    score = x4[some] @ y4[j:last].T
                    if same:
                        score[some[:, None] >= np.arange(j, last)] = -2
                    if score.max() < floor - slack:
                        continue
                    if np.count_nonzero(score >= floor - slack) > 64 * k:  # so many are as good as this
                        floor = max(floor, float(np.partition(score, score.size - k, axis=None)[score.size - k]) - slack)
                    at, to = np.nonzero(score >= floor - slack)
                    for c in range(0, len(at), 65_536):
                        row, column = some[at[c : c + 65_536]], j + to[c : c + 65_536]
                        exact = np.round(np.einsum("ij,ij->i", x[row], y[column]) * scale).astype(np.int64)
                        one, two = rank[row], rank[len(ids) + column]
                        kept = np.concatenate([kept, np.stack([-exact, np.minimum(one, two), np.maximum(one, two), row, column], axis=1)])
                        kept = kept[np.lexsort((kept[:, 2], kept[:, 1], kept[:, 0]))[:k]]
                    if len(kept) == k:
                        floor = max(floor, -kept[-1, 0] / scale)
            row, column = kept[:, 3], kept[:, 4]
            swap = rank[row] > rank[len(ids) + column]
            found = [names.take(pa.array(np.where(s, len(ids) + column, row))) for s in (swap, ~swap)]
            return pa.table({"query": found[0], "id": found[1], "score": pa.array(np.einsum("ij,ij->i", x[row], y[column]))})

        chosen = F.broadcast(groups.sparkSession.createDataFrame(tiles, "_a int, _b int"))
        sides = [groups.join(chosen, F.col("_g") == F.col(c)).withColumn("_first", F.lit(c == "_a")) for c in ("_a", "_b")]
        sides[1] = sides[1].filter("_a <> _b")
        return sides[0].unionByName(sides[1]).groupBy("_a", "_b").applyInArrow(tile, f"query {kind}, id {kind}, score double")


def build(records: DataFrame, record_id: str, vector: str, k: int = 3, cells: int | None = None, sample: int = SAMPLE, recall: float = 0.98, digits: int = 6, seed: int = 0) -> Index:
    """An index of all rows for searches of up to k neighbours.

    Fitted on `sample` members chosen by a hash of their ids: centroids (the root of the number of members, CELLS at most),
    and how many cells must be visited so that the sample's own neighbours are found with the given recall.
    """
    kind = records.schema[record_id].dataType.simpleString()
    found = written(members(usable(records, record_id, vector), k + 1), "members")
    n = found.count()
    some = found.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).select("v").toArrow()
    x = _matrix(some.column("v").combine_chunks()) if len(some) else np.ones((1, 1))
    cells = max(1, min(cells or int(np.sqrt(max(n, 1))), CELLS, len(x)))
    centroids = spherical_means(x, cells, seed=seed)
    visit = visits_for(x, centroids, k, recall, seed)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            similar = _matrix(batch.column(1)) @ centroids.T if len(batch) else np.zeros((0, 1))
            cell = similar.argmax(axis=1) if len(batch) else np.zeros(0, np.int64)
            angle = np.arccos(np.clip(similar[np.arange(len(batch)), cell], -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angle)], names=["id", "v", "ids", "cell", "angle"])

    placed = written(found.mapInArrow(place, f"id {kind}, v array<double>, ids array<{kind}>, cell int, angle double"), "cells")
    sizes, radius = np.zeros(cells, np.int64), np.zeros(cells)
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("r")).collect():  # a row a cell
        sizes[r["cell"]], radius[r["cell"]] = r["n"], r["r"]
    return Index(centroids, visit, placed, sizes, radius, k, digits)


def visits_for(x: np.ndarray, centroids: np.ndarray, k: int, recall: float, seed: int = 0, queries: int = 500) -> int:
    """How many nearest cells hold `recall` of the k nearest neighbours of some of the vectors, among these vectors."""
    if len(x) < 2:
        return 1
    cell = (x @ centroids.T).argmax(axis=1)
    some = np.random.default_rng(seed).choice(len(x), min(queries, len(x)), replace=False)
    similar = x[some] @ x.T
    similar[np.arange(len(some)), some] = -2
    k = min(k, len(x) - 1)
    near = np.argpartition(-similar, k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(x[some] @ centroids.T), axis=1), axis=1)  # of each cell, for each query
    needed = np.sort(np.take_along_axis(place, cell[near], axis=1).ravel()) + 1
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])


def recall(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row: n_wanted, n_found (of the wanted), recall, of two tables of query_index and neighbor_index."""
    key = ["query_index", "neighbor_index"]
    both = wanted.select(*key).join(found.select(*key, F.lit(1).alias("hit")), key, "left")
    return both.agg(F.count(F.lit(1)).alias("n_wanted"), F.count("hit").alias("n_found"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))
