"""Pairs of records: all, across sources, paired rows, blocked by rules, by tokens, by TF-IDF neighbours.

Pairs are long tables of (left_id, right_id), never matrices. All-pairs scopes are for sets of checked size; corpora
use blocks, whose pairs are found by equi-joins on keys.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.storage import written

#: All-pairs scopes, and blocks, raise beyond so many pairs.
MAX_PAIRS = 500_000_000
#: Rows of one key that one task joins; a key with more is dealt over several.
HEAVY = 5_000
#: Most rows of a block of vectors, most tasks that tiles are dealt to, and pairs that are scored at once.
MOST_ROWS, MOST_TASKS, SLICE = 8192, 2000, 1 << 20
#: Most rows of a block whose pairs are chosen by bounds: fewer blocks send vectors less often, and give fewer rows.
WIDE_ROWS = 32768


def _side(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def dealt_join(left: DataFrame, right: DataFrame, key: list[str], by: str, heavy: int | None = None, largest: int | None = None) -> DataFrame:
    """Inner join on columns that both sides have, for keys that make many pairs.

    A key's rows on either side are dealt by a hash over parts of about `heavy` (HEAVY) rows, and each part of the left meets
    each of the right: no task has more than heavy * heavy pairs of a key, and rows are sent as often as the other side has
    parts. by: the left column that is hashed; right rows are by all their columns. Both sides are counted in one
    aggregation, unless no key has more than `largest` rows and that is not over `heavy`.
    """
    heavy = heavy or HEAVY
    if largest is not None and largest <= heavy:
        return left.join(right, key)
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    rows = left.select(*key, one.alias("_l"), none.alias("_r")).unionAll(right.select(*key, none.alias("_l"), one.alias("_r")))
    parts = lambda c: F.ceil(F.sum(c) / heavy).cast("int")
    counted = rows.groupBy(*key).agg(parts("_l").alias("_lp"), parts("_r").alias("_rp")).filter("_lp > 0 and _rp > 0 and (_lp > 1 or _rp > 1)")
    crowded = written(counted, "heavy-keys")
    if crowded.isEmpty():
        return left.join(right, key)
    lp, rp = F.coalesce("_lp", F.lit(1)), F.coalesce("_rp", F.lit(1))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = lambda n, *c: F.pmod(F.xxhash64(*c), n).cast("int")
    rest = [c for c in right.columns if c not in key]
    a = left.join(crowded, key, "left").withColumn("_a", own(lp, by)).withColumn("_b", every(rp)).drop("_lp", "_rp")
    b = right.join(crowded, key, "left").withColumn("_b", own(rp, *rest) if rest else F.lit(0)).withColumn("_a", every(lp)).drop("_lp", "_rp")
    return a.join(b, [*key, "_a", "_b"]).drop("_a", "_b")


def all_pairs(records: DataFrame, record_id: str, columns: list[str] = (), most: int | None = MAX_PAIRS, condition: Column | None = None) -> DataFrame:
    """Each unordered pair once, the smaller id left, with left_ and right_ columns.

    The pair count is checked before anything runs (most=None: never); one side is dealt to all tasks, and Spark sends the other to each.
    """
    if most is not None and (n := records.count()) * (n - 1) // 2 > most:
        raise ValueError(f"{n} records make {n * (n - 1) // 2} pairs, over the limit of {most}; block them first")
    kept = records.select(F.col(record_id).alias("id"), *[c for c in columns if c != "id"])
    tasks = records.sparkSession.sparkContext.defaultParallelism
    left, right = _side(kept.repartition(tasks), "left_"), _side(kept, "right_")
    on = F.col("left_id") < F.col("right_id")
    return left.join(right, on if condition is None else on & condition)


@dataclass
class Scores:
    """Some rows of a tile: cosines (NaN: none) of left ids a with right ids b, which pairs count, and which have one target."""

    a: np.ndarray
    b: np.ndarray
    score: np.ndarray
    valid: np.ndarray
    target: np.ndarray


#: Chooses pairs of some scores: a mask of them. Those with a method `choose` take a whole Tile instead.
Keep = Callable[[Scores], np.ndarray]


def of_target(target: int) -> Keep:
    """Pairs whose target it is."""
    return lambda t: t.valid & (t.target == bool(target))


@dataclass
class Tile:
    """Two groups of unit vectors (or one with itself), their ids' order, and codes of same and apart (-1: none).

    Products of single precision tell which pairs can matter, within `margin`; those alone get their exact scores.
    """

    x: np.ndarray
    y: np.ndarray
    a: np.ndarray
    b: np.ndarray
    same: tuple[np.ndarray, np.ndarray]
    apart: tuple[np.ndarray, np.ndarray]
    diagonal: bool
    digits: int | None

    def __post_init__(self) -> None:
        self.margin = (self.x.shape[1] + 4) * 1.2e-7 + (0 if self.digits is None else 0.51 * 10.0**-self.digits)
        self.there = tuple(np.isfinite(v).all(1) for v in (self.x, self.y))

    def turned(self) -> Tile:
        return Tile(self.y, self.x, self.b, self.a, self.same[::-1], self.apart[::-1], self.diagonal, self.digits)

    def slices(self, most: int) -> Iterator[tuple[int, np.ndarray]]:
        """The first row of each slice and its products; -3 without a score, as these come last."""
        left, right = self.x.astype(np.float32), self.y.astype(np.float32).T
        step = max(1, most // max(1, len(self.y)))
        for start in range(0, len(left) if len(self.y) else 0, step):
            raw = left[start : start + step] @ right
            raw[~self.there[0][start : start + step]] = -3
            if not self.there[1].all():
                raw[:, ~self.there[1]] = -3
            yield start, raw

    def counts(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Which of some pairs are pairs, each once."""
        out = r < c if self.diagonal else np.ones(len(r), bool)
        if (self.apart[0] >= 0).any() or (self.apart[1] >= 0).any():
            p, q = self.apart[0][r], self.apart[1][c]
            out &= (p != q) & (p >= 0) & (q >= 0)
        return out

    def target(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (self.same[0][r] == self.same[1][c]) & (self.same[0][r] >= 0)

    def score(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        parts = [np.einsum("ij,ij->i", self.x[r[i : i + 65536]], self.y[c[i : i + 65536]]) for i in range(0, len(r), 65536)]
        return _rounded(np.concatenate([np.zeros(0), *parts]), self.digits)


def _rounded(score: np.ndarray, digits: int | None) -> np.ndarray:
    return score if digits is None else np.copysign(np.floor(np.abs(score) * 10**digits + 0.5), score) / 10**digits


def _once(tile: Tile, found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    at = np.unique(np.concatenate([np.zeros(0, np.int64), *[r * len(tile.y) + c for r, c in found]]))
    return at // max(1, len(tile.y)), at % max(1, len(tile.y))


@dataclass(frozen=True)
class from_score:
    """Pairs with that score or more."""

    threshold: float

    def choose(self, tile: Tile) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for start, raw in tile.slices(SLICE):
            r, c = np.divmod(np.flatnonzero(raw >= self.threshold - tile.margin), len(tile.y))
            some = tile.counts(r + start, c)
            r, c = r[some] + start, c[some]
            some = tile.score(r, c) >= self.threshold
            yield r[some], c[some]


class ends:
    """The k best pairs of each kind (a target or None for both; True for the largest scores), ties by ids, no score last.

    A tile's k-th best so far is a bound that later slices are compared with at once."""

    def __init__(self, k: int, *kinds: tuple[int | None, bool]) -> None:
        self.k, self.kinds = k, kinds

    def choose(self, tile: Tile) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        k, none = self.k, np.zeros(0, np.int64)
        best = {kind: (none.astype(float), none, none) for kind in self.kinds}
        for start, raw in tile.slices(SLICE):
            for kind in self.kinds:
                target, largest = kind
                s, r, c = best[kind]
                full = len(s) == k
                if largest:
                    x = raw
                else:
                    x = np.where(raw < -2, raw, -raw) if not all(t.all() for t in tile.there) else -raw
                if target == 1 and not full:
                    codes = tile.same[0][start : start + len(raw)]
                    hits = np.flatnonzero((codes[:, None] == tile.same[1][None, :]) & (codes >= 0)[:, None])
                else:
                    hits = np.flatnonzero(x >= s[-1] - tile.margin) if full else np.arange(x.size)
                p, q = np.divmod(hits, len(tile.y))
                some = tile.counts(p + start, q)
                if target is not None:
                    some &= tile.target(p + start, q) == bool(target)
                hits, p, q = hits[some], p[some] + start, q[some]
                if len(hits) > 4 * k:
                    v = x.ravel()[hits]
                    some = v >= np.partition(v, len(v) - k)[len(v) - k] - 2 * tile.margin
                    p, q = p[some], q[some]
                found = tile.score(p, q)
                found = np.where(np.isnan(found), -3.0, found if largest else -found)
                s, r, c = np.concatenate([s, found]), np.concatenate([r, p]), np.concatenate([c, q])
                order = np.lexsort((np.maximum(tile.a[r], tile.b[c]), np.minimum(tile.a[r], tile.b[c]), -s))[:k]
                best[kind] = s[order], r[order], c[order]
        yield _once(tile, [(r, c) for _, r, c in best.values()])


@dataclass(frozen=True)
class nearest:
    """The k best pairs of each record, among those at hand; ties by the other's id, no score last."""

    k: int

    def _of_rows(self, tile: Tile) -> tuple[np.ndarray, np.ndarray]:
        """For each row of the left side its k best of the right."""
        k, found = self.k, []
        parted = (tile.apart[0] >= 0).any() or (tile.apart[1] >= 0).any()
        for start, raw in tile.slices(SLICE):
            n, m = raw.shape
            if tile.diagonal:
                raw[np.arange(n), start + np.arange(n)] = -np.inf
            if parted:
                p, q = tile.apart[0][start : start + n, None], tile.apart[1][None, :]
                raw[(p == q) | (p < 0) | (q < 0)] = -np.inf
            # the k-th best of some is a bound for all
            some = raw[:, : max(512, 4 * k)]
            bound = np.partition(some, some.shape[1] - k, axis=1)[:, some.shape[1] - k] if some.shape[1] > k else np.full(n, -np.inf, np.float32)
            r, c = np.divmod(np.flatnonzero((raw >= (bound - 2 * tile.margin)[:, None]) & (raw > -np.inf)), m)
            v = raw[r, c]
            order = np.lexsort((-v, r))
            r, c, v = r[order], c[order], v[order]
            first = np.searchsorted(r, np.arange(n))
            kth = np.minimum(first + k, np.searchsorted(r, np.arange(n), "right")) - 1
            some = v >= v[kth[r]] - 2 * tile.margin if len(v) else np.zeros(0, bool)
            r, c = r[some], c[some]
            s = tile.score(r + start, c)
            order = np.lexsort((tile.b[c], -np.where(np.isnan(s), -3.0, s), r))
            r, c = r[order], c[order]
            some = np.arange(len(r)) - np.searchsorted(r, r) < k
            found.append((r[some] + start, c[some]))
        return tuple(np.concatenate([np.zeros(0, np.int64), *[f[i] for f in found]]) for i in (0, 1))

    def choose(self, tile: Tile) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        r, c = self._of_rows(tile)
        if tile.diagonal:
            yield _once(tile, [(np.minimum(r, c), np.maximum(r, c))])
        else:
            yield _once(tile, [(r, c), self._of_rows(tile.turned())[::-1]])


@dataclass
class _Tiles:
    """Rows by tile: each vector goes once to each tile of its block with another one."""

    rows: DataFrame
    kind: str
    width: int
    digits: int | None

    def load(self, batches: Iterator[pa.RecordBatch], unit: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Rows of either side, ids, vectors, and codes of same and apart."""
        table = pa.Table.from_batches(list(batches))
        (i, j), side = (table.column(c)[0].as_py() for c in ("i", "j")), table.column("side").to_numpy()
        codes = [np.where(c.is_null().to_numpy(), -1, c.fill_null("").combine_chunks().dictionary_encode().indices.to_numpy()) for c in (table.column("same"), table.column("apart"))]
        ids = table.column("id").to_numpy()
        x = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(table), self.width)
        if unit:
            length = np.sqrt((x * x).sum(1, keepdims=True))
            x = x / np.where(length == 0, 1, length)
        p = np.flatnonzero(side == 0)
        return p, p if i == j else np.flatnonzero(side == 1), ids, x, codes

    def tile(self, batches: Iterator[pa.RecordBatch]) -> tuple[Tile, np.ndarray, np.ndarray]:
        """A tile, and the ids of its sides."""
        p, q, ids, x, codes = self.load(batches)
        order = np.unique(ids, return_inverse=True)[1]
        return Tile(x[p], x[q], order[p], order[q], *[(c[p], c[q]) for c in codes], q is p, self.digits), ids[p], ids[q]

    def scores(self, batches: Iterator[pa.RecordBatch], most: int) -> Iterator[Scores]:
        """Scores of a tile, about `most` pairs at once."""
        p, q, ids, x, codes = self.load(batches)
        step = max(1, most // max(1, len(q)))
        for start in range(0, len(p) if len(q) else 0, step):
            own = p[start : start + step]
            score = _rounded(x[own] @ x[q].T, self.digits)
            valid = np.arange(len(q))[None, :] > (start + np.arange(len(own)))[:, None] if q is p else np.ones(score.shape, bool)
            same, apart = ([c[own][:, None], c[q][None, :]] for c in codes)
            if (codes[1] >= 0).any():
                valid = valid & (apart[0] != apart[1]) & (apart[0] >= 0) & (apart[1] >= 0)
            yield Scores(ids[own], ids[q], score, valid, (same[0] == same[1]) & (same[0] >= 0))


def _tiles(records: DataFrame, record_id: str, vector: str, same: str | None, apart: str | None, most: int | None, block: int | None, digits: int | None, most_rows: int = MOST_ROWS) -> _Tiles:
    size = records.agg(F.count(F.lit(1)).alias("n"), F.min(F.size(vector)).alias("a"), F.max(F.size(vector)).alias("b"), F.count(vector).alias("there")).first()
    n, width = size["n"], size["b"] if size["there"] else 0
    if most is not None and n * (n - 1) // 2 > most:
        raise ValueError(f"{n} records make {n * (n - 1) // 2} pairs, over the limit of {most}; block them first")
    if records.filter(F.col(vector).isNotNull() & (F.size(vector) != width)).limit(1).count():
        raise ValueError(f"the vectors of {vector} differ in length")
    blocks = max(1, -(-n // (block or min(most_rows, max(256, -(-n // 16))))))
    number = "float" if records.schema[vector].dataType.simpleString() == "array<float>" else "double"
    numbers = F.coalesce(F.col(vector).cast(f"array<{number}>"), F.array_repeat(F.lit(math.nan).cast(number), width))
    text = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    rows = records.select(F.col(record_id).alias("id"), text(same).alias("same"), text(apart).alias("apart"), numbers.alias("v"), F.pmod(F.xxhash64(record_id), F.lit(blocks)).cast("int").alias("b"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = rows.withColumn("o", other).select("id", "same", "apart", "v", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), (F.col("b") > F.col("o")).cast("int").alias("side"))
    tiles = blocks * (blocks + 1) // 2
    return _Tiles(dealt.repartition(min(tiles, MOST_TASKS), "i", "j"), records.schema[record_id].dataType.simpleString(), width, digits)


def cosine_pairs(records: DataFrame, record_id: str, vector: str, same: str | None = None, most: int | None = MAX_PAIRS, block: int | None = None, digits: int | None = None, keep: Keep | None = None, apart: str | None = None) -> DataFrame:
    """Each unordered pair once, the smaller id left, and the cosine of their vectors: left_id, right_id, score.

    same: a column that adds target, 1 if it is equal on both sides (null never is). apart: a column that must differ (null
    is in no pair). Rows are put in blocks by a hash (of about `block`; by default a sixteenth, from 256 to MOST_ROWS); each
    pair of blocks is a tile, which one task multiplies slice by slice. keep: which pairs leave the task (see from_score,
    of_target, ends, nearest), so that rows grow with what is kept; ends and nearest give some more than are the best in the end.
    digits: scores are rounded to so many. A zero vector's cosines are 0; without a vector they are null. The pair count is
    checked before anything runs (most=None: never); vectors must be of one length.
    """
    chosen = hasattr(keep, "choose")
    tiles = _tiles(records, record_id, vector, same, apart, most, block, digits, WIDE_ROWS if chosen else MOST_ROWS)

    def choose(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, a, b = shape.tile(batches)
        for row, column in keep.choose(tile):
            score = tile.score(row, column)
            if len(row):
                yield pa.RecordBatch.from_arrays([pa.array(a[row]), pa.array(b[column]), pa.array(score, mask=np.isnan(score)), pa.array(tile.target(row, column).astype(np.int32))], names=["a", "b", "score", "target"])

    def work(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in shape.scores(batches, SLICE if keep is None else 2 * SLICE):
            row, column = np.nonzero(t.valid if keep is None else keep(t))
            score = t.score[row, column]
            if len(row):
                yield pa.RecordBatch.from_arrays([pa.array(t.a[row]), pa.array(t.b[column]), pa.array(score, mask=np.isnan(score)), pa.array(t.target[row, column].astype(np.int32))], names=["a", "b", "score", "target"])

    shape = _Tiles(None, tiles.kind, tiles.width, digits)  # without the DataFrame, which tasks can't have
    found = tiles.rows.groupBy("i", "j").applyInArrow(choose if chosen else work, f"a {tiles.kind}, b {tiles.kind}, score double, target int")
    return found.select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"), "score", *["target"] * bool(same))


def cosine_counts(records: DataFrame, record_id: str, vector: str, same: str, digits: int = 6, most: int | None = MAX_PAIRS, block: int | None = None, apart: str | None = None) -> DataFrame:
    """score (rounded), target, n: how many of cosine_pairs have them. Tasks count, so rows grow with the distinct scores, of
    which there are 2 * 10 ** digits + 1 at most, and not with the pairs."""
    tiles = _tiles(records, record_id, vector, same, apart, most, block, digits)
    scale = 10**digits
    bins = 2 * scale + 2  # the last one for pairs without a score

    def work(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * bins, np.int64)
        for t in tiles_scores(batches, SLICE):
            at = np.where(np.isnan(t.score), bins - 1, np.rint(t.score * scale) + scale).astype(np.int64) + t.target * bins
            counts += np.bincount(at[t.valid], minlength=2 * bins)
        found = np.flatnonzero(counts)
        place = found % bins
        for start in range(0, len(found), SLICE):
            own = slice(start, start + SLICE)
            yield pa.RecordBatch.from_arrays([pa.array((place[own] - scale) / scale, mask=place[own] == bins - 1), pa.array((found[own] // bins).astype(np.int32)), pa.array(counts[found[own]])], names=["score", "target", "n"])

    tiles_scores = _Tiles(None, tiles.kind, tiles.width, digits).scores
    found = tiles.rows.groupBy("i", "j").applyInArrow(work, "score double, target int, n long")
    return found.groupBy("score", "target").agg(F.sum("n").alias("n"))


def cross_source_pairs(records: DataFrame, record_id: str, source: str, columns: list[str] = (), most: int | None = MAX_PAIRS) -> DataFrame:
    """Pairs whose sources differ."""
    columns = [*dict.fromkeys([source, *columns])]
    return all_pairs(records, record_id, columns, most, F.col(f"left_{source}") != F.col(f"right_{source}"))


def pair_scope_counts(records: DataFrame, source: str) -> DataFrame:
    """n_pairs across sources and excluded_pairs within them, from counts alone."""
    sizes = records.groupBy(source).agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n").alias("n"), F.sum(F.expr("n * (n - 1) div 2")).alias("within"))
    return total.select((F.expr("n * (n - 1) div 2") - F.col("within")).alias("n_pairs"), F.col("within").alias("excluded_pairs"))


def paired_rows(records: DataFrame, pair_id: str, side: str, left: str, right: str, columns: list[str]) -> DataFrame:
    """The two rows of each pair id, one of each side; groups of any other make are left out. One aggregation, no join."""
    # a group is well formed if it has two rows, one of each side
    marks = records.filter(F.col(pair_id).isNotNull()).groupBy(pair_id).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col(side) == left).alias("_l"),
        F.count_if(F.col(side) == right).alias("_r"),
        *[F.max_by(c, F.when(F.col(side) == s, 1)).alias(f"{p}_{c}") for p, s in (("left", left), ("right", right)) for c in columns],
    )
    return marks.filter("_n = 2 and _l = 1 and _r = 1").drop("_n", "_l", "_r")


# -- blocking by rules -------------------------------------------------------------------------------------------

#: Parts of column names that make a column a blocking rule of the first choice (fixed values).
BLOCKING_NAMES = ("surname", "last", "phone", "postcode", "zip", "year")


def blocking_rules(field_types: dict[str, str]) -> list[str]:
    """Columns to block on: identifiers, phones, categories and telling names first, then two others at most."""
    first = [c for c, t in field_types.items() if t in ("identifier", "phone", "email", "categorical") or any(n in c.lower() for n in BLOCKING_NAMES)]
    return first + [c for c in field_types if c not in first][:2]


def prior_rules(field_types: dict[str, str]) -> list[str]:
    return blocking_rules(field_types)[:3]


def _blocks(records: DataFrame, rule: str, skip_blank: bool = True) -> DataFrame:
    """The records that a rule puts in a block."""
    return records.filter(F.col(rule).isNotNull() & (F.col(rule).cast("string") != "" if skip_blank else F.lit(True)))


def blocked_pairs(records: DataFrame, record_id: str, rules: list[str], columns: list[str] = (), skip_blank: bool = True, most: int | None = MAX_PAIRS) -> DataFrame:
    """Pairs that agree on one rule or more: left_id, right_id, match_key (the first such rule), and columns of both sides.

    Rules are columns; each is an equi-join. A pair is left to the first rule it agrees on, so no distinct is needed.
    Null never matches, nor (with skip_blank) the empty string. Block sizes tell how many pairs each rule makes: beyond
    `most` in all it raises (None: never), and blocks of many rows are dealt over several tasks. One aggregation gives the
    sizes of all rules.
    """
    if not rules:
        raise ValueError("no blocking rules")
    kept = [*dict.fromkeys([*rules, *columns])]
    base = records.select(F.col(record_id).alias("id"), *[c for c in kept if c != "id"])
    sizes = _rule_sizes(base, rules, skip_blank)
    if most is not None and sum(n for n, _ in sizes.values()) > most:
        raise ValueError(f"the rules make { {r: n for r, (n, _) in sizes.items()} } pairs, over the limit of {most}; use finer rules")
    out = None
    for i, rule in enumerate(rules):
        rows = _blocks(base, rule, skip_blank).withColumn("_key", F.col(rule))
        left, right = (rows.select("_key", *[F.col(c).alias(f"{s}_{c}") for c in base.columns]) for s in ("left", "right"))
        pairs = dealt_join(left, right, ["_key"], "left_id", largest=sizes[rule][1]).filter("left_id < right_id")
        for earlier in rules[:i]:
            agree = F.col(f"left_{earlier}") == F.col(f"right_{earlier}")
            if skip_blank:
                agree = agree & (F.col(f"left_{earlier}").cast("string") != "")
            pairs = pairs.filter(~F.coalesce(agree, F.lit(False)))
        pairs = pairs.select("left_id", "right_id", F.lit(f"exact:{rule}").alias("match_key"), *[f"{s}_{c}" for c in kept if c != "id" for s in ("left", "right")])
        out = pairs if out is None else out.unionByName(pairs)
    return out


def _rule_sizes(records: DataFrame, rules: list[str], skip_blank: bool) -> dict[str, tuple[int, int]]:
    """How many pairs each rule makes, and the rows of its largest block."""
    keys = F.array(*[F.struct(F.lit(i).alias("rule"), F.col(r).cast("string").alias("key")) for i, r in enumerate(rules)])
    rows = records.select(F.explode(keys).alias("x")).select("x.*").filter(F.col("key").isNotNull() & (F.col("key") != "" if skip_blank else F.lit(True)))
    sizes = rows.groupBy("rule", "key").agg(F.count(F.lit(1)).alias("n")).groupBy("rule").agg(F.sum(F.expr("n * (n - 1) div 2")).alias("pairs"), F.max("n").alias("most"))
    found = {r["rule"]: (r["pairs"], r["most"]) for r in sizes.collect()}  # a row a rule
    return {rule: found.get(i, (0, 0)) for i, rule in enumerate(rules)}


def blocked_pair_count(records: DataFrame, rule: str | list[str]) -> DataFrame:
    """n_pairs that a rule (or several at once) makes, from block sizes alone."""
    rules = [rule] if isinstance(rule, str) else list(rule)
    sizes = records.dropna(subset=rules).groupBy(*rules).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.agg(F.coalesce(F.sum(F.expr("_n * (_n - 1) div 2")), F.lit(0)).alias("n_pairs"))


def rule_pair_count(records: DataFrame, rules: list[str], skip_blank: bool = True) -> int:
    """How many pairs agree on one of a few rules or more, by inclusion and exclusion over block sizes; no pair is made."""
    if len(rules) > 6:
        raise ValueError("inclusion and exclusion is for six rules at most")
    names = [f"_r{i}" for i in range(len(rules))]
    base = records.select(*[(F.nullif(F.col(r).cast("string"), F.lit("")) if skip_blank else F.col(r)).alias(n) for r, n in zip(rules, names)])
    # all sets of rules in one aggregation; a bit of _out is set if the rule isn't in the set
    sizes = base.cube(*names).agg(F.count(F.lit(1)).alias("_n"), F.grouping_id().alias("_out"))
    for i, n in enumerate(reversed(names)):
        sizes = sizes.filter((F.shiftright("_out", i).bitwiseAND(F.lit(1)) == 1) | F.col(n).isNotNull())
    used = F.lit(len(rules)) - F.bit_count("_out")
    signed = F.when(used % 2 == 1, F.expr("_n * (_n - 1) div 2")).otherwise(-F.expr("_n * (_n - 1) div 2"))
    return int(sizes.filter(used > 0).agg(F.coalesce(F.sum(signed), F.lit(0)).alias("n")).first()["n"])


def sampled_block_pairs(records: DataFrame, record_id: str, rule: str, columns: list[str], most: int, seed: int = 2) -> DataFrame:
    """blocked_pairs of one rule, or about `most` of them: blocks are then cut by a hash of the ids into as many parts as needed.

    That is a sample for estimates; two records meet if the hash puts them into one part of their block.
    """
    rows = _blocks(records, rule)
    parts = max(1, -(-rule_pair_count(records, [rule]) // max(most, 1)))
    if parts == 1:
        return blocked_pairs(records, record_id, [rule], columns)
    part = F.pmod(F.xxhash64(F.col(record_id), F.lit(seed)), F.lit(parts))
    cut = rows.withColumn("_rule", F.concat_ws("\x1f", F.col(rule).cast("string"), part.cast("string")))
    return blocked_pairs(cut, record_id, ["_rule"], [*dict.fromkeys([rule, *columns])], most=None)


# -- token blocking and meta-blocking ----------------------------------------------------------------------------


def token_blocks(records: DataFrame, record_id: str, columns: list[str]) -> DataFrame:
    """(token, id): each record is in the block of each distinct word of its values."""
    text = F.concat_ws(" ", *[F.col(c).cast("string") for c in columns])
    words = F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != ""))
    return records.select(F.col(record_id).alias("id"), F.explode(words).alias("token"))


def block_sizes(blocks: DataFrame) -> DataFrame:
    """token, n of blocks that make a pair."""
    return blocks.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")


def purge_limit(blocks: DataFrame, smoothing: float = 1.025) -> int:
    """The largest block size that is kept.

    Sizes are taken in ascending order with running sums of assignments and comparisons; from the largest size down,
    the first at which a further size no longer raises comparisons per assignment by `smoothing` is the limit.
    """
    sizes = block_sizes(blocks).groupBy("n").agg(F.count(F.lit(1)).alias("blocks"))
    rows = sorted((r["n"], r["blocks"]) for r in sizes.collect())  # a row for each distinct block size
    stats, assignments, comparisons = [], 0, 0
    for n, count in rows:
        assignments += n * count
        comparisons += n * (n - 1) // 2 * count
        stats.append((n, assignments, comparisons))
    limit = stats[-1][0] if stats else 0
    for (n, a, c), (_, a2, c2) in zip(stats[-2::-1], stats[:0:-1]):
        if a * c2 < smoothing * a2 * c:
            return limit
        limit = n
    return limit


def purge_blocks(blocks: DataFrame, limit: int | None = None) -> DataFrame:
    """Blocks no larger than the limit (purge_limit's if not given)."""
    limit = purge_limit(blocks) if limit is None else limit
    kept = block_sizes(blocks).filter(F.col("n") <= limit)
    return blocks.join(kept, "token")


def filter_blocks(sized: DataFrame, ratio: float = 0.9) -> DataFrame:
    """For each record its smallest blocks, `ratio` of them (rounded); input (id, token, n)."""
    by = Window.partitionBy("id")
    ranked = sized.withColumn("_rank", F.row_number().over(by.orderBy("n", "token"))).withColumn("_all", F.count(F.lit(1)).over(by))
    return ranked.filter(F.col("_rank") <= F.floor(F.col("_all") * ratio + 0.5)).drop("_rank", "_all")


def entity_index(blocks: DataFrame) -> DataFrame:
    """(id, blocks): each record's blocks as hashes of their tokens, smallest blocks first; blocks of one record make no pair."""
    blocks = blocks.select("token", "id")
    sized = blocks.join(block_sizes(blocks), "token")
    ordered = sized.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", F.xxhash64("token").alias("b")))).alias("x"))
    return ordered.select("id", F.transform("x", lambda x: x["b"]).alias("blocks"))


def block_pairs(blocks: DataFrame) -> DataFrame:
    """left_id, right_id, weight: the number of blocks two records share.

    Two records meet in each block that they share, but become a row only in the first of those, smallest blocks first; the
    weight comes from both records' lists of blocks (see entity_index). So rows grow with pairs, not with shared blocks, and
    pairs aren't shuffled.
    """
    index = written(entity_index(blocks), "entity-index")
    # a record goes to a block with all its blocks, as those tell the first common one and the weight
    rows = index.select("id", "blocks", F.explode("blocks").alias("b"))
    a, b = rows.select("b", F.col("id").alias("left_id"), F.col("blocks").alias("left_blocks")), rows.select("b", F.col("id").alias("right_id"), F.col("blocks").alias("right_blocks"))
    met = dealt_join(a, b, ["b"], "left_id").filter("left_id < right_id").withColumn("common", F.array_intersect("left_blocks", "right_blocks"))
    return met.filter(F.element_at("common", 1) == F.col("b")).select("left_id", "right_id", F.size("common").cast("long").alias("weight"))


def weighted_edge_pruning(pairs: DataFrame) -> DataFrame:
    """Pairs whose weight is the mean or more. They are counted first and made again then, so they are never stored."""
    mean = pairs.agg(F.avg("weight").alias("_mean"))
    return pairs.crossJoin(F.broadcast(mean)).filter("weight >= _mean").drop("_mean")  # one row


# -- TF-IDF neighbours -------------------------------------------------------------------------------------------


def char_grams(text: Column, sizes: tuple[int, ...] = (3, 4, 5)) -> Column:
    """Character n-grams within words, each word between spaces; a word shorter than all sizes counts whole, once."""

    def of_word(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        length, none = F.length(padded), F.array().cast("array<string>")

        def cut(n: int) -> Column:
            return F.transform(F.sequence(F.lit(1), F.greatest(length - (n - 1), F.lit(1))), lambda i: F.substring(padded, i, F.lit(n)))

        cuts = [F.when(length >= n, cut(n)).otherwise(none) for n in sizes]
        return F.concat(*cuts, F.when(length < min(sizes), F.array(padded)).otherwise(none))

    words = F.filter(F.split(F.lower(text), "\\s+"), lambda w: w != "")
    return F.flatten(F.transform(words, of_word))


def tfidf_neighbours(left: DataFrame, right: DataFrame, left_id: str, left_text: str, right_id: str, right_text: str, k: int = 10, sizes: tuple[int, ...] = (3, 4, 5)) -> DataFrame:
    """left_id, right_id, rank, score: for each left row the k right rows with the largest cosine.

    Vocabulary and smoothed idf come from the right side alone; weights are counts times idf, L2-normalised. Rows that
    share no n-gram are no candidates. A right side that fits a task is scored where the left texts are (see gramindex), so
    that their n-grams are no rows; of a larger one, only rows that can be among the best k are compared (see simjoin.top_k).
    """
    from kindred.operators import gramindex
    from kindred.operators.simjoin import top_k

    grams = lambda df, i, t: df.select(F.col(i).alias("id"), F.explode(char_grams(F.col(t), sizes)).alias("gram")).groupBy("id", "gram").agg(F.count(F.lit(1)).alias("tf"))
    r = written(grams(right, right_id, right_text), "grams")  # read for the frequencies and for the weights
    n = right.select(F.count(F.lit(1)).alias("n"))
    idf = r.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("gram", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))

    def weighted(side: DataFrame, name: str) -> DataFrame:
        w = side.join(idf, "gram").withColumn("w", F.col("tf") * F.col("idf"))
        norms = w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        return w.join(norms, "id").select("gram", F.col("id").alias(name), (F.col("w") / F.col("norm")).alias("w"), "idf")

    size = r.agg(F.count(F.lit(1)).alias("cells"), F.count_distinct("id").alias("rows")).first()
    if size["cells"] <= gramindex.MOST_CELLS and size["rows"] <= gramindex.MOST_ROWS:
        texts = left.select(F.col(left_id).alias("left_id"), F.lower(F.col(left_text)).alias("t"))
        return gramindex.best_rows(gramindex.one_text_an_id(texts), weighted(r, "right_id"), k, sizes)
    return top_k(weighted(grams(left, left_id, left_text), "left_id").drop("idf"), weighted(r, "right_id").drop("idf"), k).drop("compared")


def split_pairs(pairs: DataFrame, sizes: dict[str, int], seed: int = 0, others: DataFrame | None = None) -> DataFrame:
    """Add split to labelled pairs (left_id, right_id, label): 60, 20 and 20 % of the positives, and negatives up to each size.

    The order of either label is that of the MD5 of `left:right:seed`; a split with more positives than its size gets
    no negatives, and no pair is in two splits. Pairs that are in none are left out. others: the negatives, if pairs holds
    positives alone; they aren't made if no split needs any.
    """
    names = list(sizes)
    key = F.md5(F.concat_ws(":", F.col("left_id").cast("string"), F.col("right_id").cast("string"), F.lit(str(seed))))
    struct = F.struct(key.alias("k"), F.col("left_id").alias("l"), F.col("right_id").alias("r"))
    positives, negatives = pairs.filter("label = 1").withColumn("_key", struct), (pairs if others is None else others).filter("label = 0").withColumn("_key", struct)
    bins = _key_bins(positives)
    n = sum(bins.values())
    # a fourth split and further ones get negatives alone
    edges = [0, int(0.6 * n), int(0.8 * n), n, *[n] * len(names)]
    quotas = [max(0, sizes[name] - (edges[i + 1] - edges[i])) for i, name in enumerate(names)]
    wanted = sum(quotas)
    negative_bins = _key_bins(negatives) if wanted else {}
    wanted = min(wanted, sum(negative_bins.values()))
    stops = np.minimum(np.cumsum(quotas), wanted).tolist()
    parts = [_between(positives, bins, edges[: len(names) + 1], names)]
    if wanted:
        parts.append(_between(negatives, negative_bins, [0, *stops], names))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


#: Rows by the first digits of their key's MD5, of which there are 65,536.
_DIGITS = 4


def _key_bins(keyed: DataFrame) -> dict[str, int]:
    first = F.substring(F.col("_key.k"), 1, _DIGITS)
    return {r["b"]: r["n"] for r in keyed.groupBy(first.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}  # 65,536 rows at most


def _between(keyed: DataFrame, bins: dict[str, int], edges: list[int], names: list[str]) -> DataFrame:
    """Rows whose place in the order of _key is from one edge to the next, and the name of that part as split.

    Only the keys at the edges are looked for, each among the rows of its bin, so the rows themselves are not sorted.
    """
    order = sorted(bins)
    starts = np.concatenate([[0], np.cumsum([bins[b] for b in order])]).astype(np.int64)
    total = int(starts[-1])
    inner = sorted({e for e in edges if 0 < e < total})
    at = {e: int(np.searchsorted(starts, e, side="right")) - 1 for e in inner}  # the bin that holds the edge's key
    bounds: dict[int, Column] = {}
    for bin_ in sorted(set(at.values())):
        own = [e for e in inner if at[e] == bin_]
        most = max(own) - int(starts[bin_]) + 1
        rows = keyed.filter(F.substring(F.col("_key.k"), 1, _DIGITS) == order[bin_]).select("_key").orderBy("_key").limit(most).collect()  # a 65,536th of the rows
        kinds = keyed.schema["_key"].dataType
        for e in own:
            k = rows[e - int(starts[bin_])]["_key"]
            bounds[e] = F.struct(*[F.lit(k[f.name]).cast(f.dataType).alias(f.name) for f in kinds.fields])
    below = lambda e: F.lit(False) if e <= 0 else F.lit(True) if e >= total else F.col("_key") < bounds[e]
    split = F.when(below(edges[0]), F.lit(None).cast("string"))
    for name, stop in zip(names, edges[1:]):
        split = split.when(below(stop), F.lit(name))
    return keyed.withColumn("split", split).filter("split is not null").drop("_key")


def purge_statistics(blocks: DataFrame) -> DataFrame:
    """n (block size), blocks, comparisons of each size."""
    return block_sizes(blocks).groupBy("n").agg(F.count(F.lit(1)).alias("blocks")).withColumn("comparisons", F.expr("n * (n - 1) div 2 * blocks"))

