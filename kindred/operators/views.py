"""Views of scored pairs: top pairs, nearest neighbours, review tables, two-table linkage.

Scored pairs are (left_id, right_id, score) with each unordered pair once. Ties are broken by ids; pairs with a null
or NaN score come last.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.operators.pairs import dealt_join
from kindred.storage import written


def _ranked(score: str = "score") -> Column:
    return F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double")).desc_nulls_last()


def top_pairs(scores: DataFrame, k: int = 10) -> DataFrame:
    """left_index, right_index, score of the k best pairs."""
    return scores.select(F.col("left_id").alias("left_index"), F.col("right_id").alias("right_index"), "score").orderBy(_ranked(), "left_index", "right_index").limit(k)


def nearest_neighbors(scores: DataFrame, k: int = 3) -> DataFrame:
    """query_index, neighbor_index, rank, score: each record's k best partners, from either side."""
    both = scores.select(F.col("left_id").alias("query_index"), F.col("right_id").alias("neighbor_index"), "score").unionByName(scores.select(F.col("right_id").alias("query_index"), F.col("left_id").alias("neighbor_index"), "score"))
    rank = F.row_number().over(Window.partitionBy("query_index").orderBy(_ranked(), "neighbor_index"))
    return both.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_index", "neighbor_index", "rank", "score")


def pair_review_table(scores: DataFrame, records: DataFrame, record_id: str, k: int = 10, columns: Sequence[str] | None = None) -> DataFrame:
    """The k best pairs with left_ and right_ columns of both records; k rows are looked up, so they are what is sent."""
    columns = [c for c in records.columns if c != record_id] if columns is None else list(columns)
    out = top_pairs(scores, k)
    for side in ("left", "right"):
        # a join that keeps the few top pairs and looks records up by id
        looked = records.select(F.col(record_id).alias(f"{side}_index"), *[F.col(c).alias(f"{side}_{c}") for c in columns])
        out = looked.join(F.broadcast(out), f"{side}_index")
    return out.select("left_index", "right_index", "score", *[f"{s}_{c}" for c in columns for s in ("left", "right")]).orderBy(_ranked(), "left_index", "right_index")


def resolve_linkage_columns(left: DataFrame, right: DataFrame, columns: Sequence[str] | Mapping[str, Sequence[str]] | None = None) -> list[tuple[str, str, str]]:
    """(canonical, left, right) names: common columns in left's order, or the given ones."""
    if isinstance(columns, str):
        raise TypeError("columns must be a sequence or mapping, not a string")
    if columns is None:
        found = [(c, c, c) for c in left.columns if c in right.columns]
        if not found:
            raise ValueError("left and right have no columns in common; give columns")
    elif isinstance(columns, Mapping):
        found = []
        for name, pair in columns.items():
            if isinstance(pair, str) or len(pair) != 2:
                raise ValueError(f"the mapping for {name!r} must name a left and a right column")
            found.append((name, pair[0], pair[1]))
    else:
        found = [(c, c, c) for c in columns]
    if not found:
        raise ValueError("columns must not be empty")
    for _, a, b in found:
        for side, df, c in (("left", left, a), ("right", right, b)):
            if c not in df.columns:
                raise ValueError(f"column {c!r} is not in the {side} table")
    return found


#: Parts that the rows of a class are numbered in before they meet.
_PARTS = 64


def _classes(rows: DataFrame, index: str, k: int) -> DataFrame:
    """A row for all that are equal but for their index: the smallest of these, and the smallest k as an array `_<index>`."""
    values = [c for c in rows.columns if c != index]
    # maps can't be grouped, so rows with one are classes of their own
    if any("map<" in f.dataType.simpleString() for f in rows.schema.fields):
        return rows.withColumn(f"_{index}", F.array(index))
    part = F.pmod(F.xxhash64(index), F.lit(_PARTS))
    kept = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*values, part).orderBy(index))).filter(F.col("_at") <= k)
    found = kept.groupBy(*values).agg(F.slice(F.array_sort(F.collect_list(index)), 1, k).alias(f"_{index}"))
    return written(found.withColumn(index, F.element_at(f"_{index}", 1)), "classes")


@dataclass(frozen=True)
class Near:
    """What a score says of a numeric canonical column: pairs that score s or more have both values, finite ones, which differ
    by reach(s) at most (infinity if it says nothing)."""

    column: str
    reach: Callable[[float], float]


def _neighbours(a: DataFrame, b: DataFrame, order: list[str]) -> DataFrame:
    """Left and right rows that follow each other in the order of canonical columns, but for those at the bounds of tasks."""
    none = lambda df: F.lit(None).cast(df.select(F.struct(*df.columns).alias("x")).schema["x"].dataType)
    one = a.select(*[F.col(f"left_{c}").alias(f"_{i}") for i, c in enumerate(order)], F.struct(*a.columns).alias("_a"), none(b).alias("_b"))
    two = b.select(*[F.col(f"right_{c}").alias(f"_{i}") for i, c in enumerate(order)], none(a).alias("_a"), F.struct(*b.columns).alias("_b"))
    by = [f"_{i}" for i in range(len(order))]
    rows = one.unionByName(two).repartitionByRange(*by).withColumn("_part", F.spark_partition_id())
    before = Window.partitionBy("_part").orderBy(*by)
    met = rows.select("_a", "_b", F.lag("_a").over(before).alias("_pa"), F.lag("_b").over(before).alias("_pb"))
    return met.select(F.coalesce("_a", "_pa").alias("_a"), F.coalesce("_b", "_pb").alias("_b")).filter("_a is not null and _b is not null").select("_a.*", "_b.*")


def _within(a: DataFrame, b: DataFrame, column: str, reach: float) -> tuple[DataFrame, DataFrame]:
    """Both sides with _bin, for rows that may differ by `reach` at most; the right ones are in three bins."""
    sides = [df.withColumn("_x", F.col(f"{s}_{column}").cast("double")).filter(F.col("_x").isNotNull() & (F.abs("_x") < float("inf"))) for s, df in (("left", a), ("right", b))]
    largest = max(df.agg(F.coalesce(F.max(F.abs("_x")), F.lit(0.0))).first()[0] for df in sides)
    # twice as wide as they differ, and wide enough for the quotients to be exact to a small part of a bin
    bin_ = F.floor(F.col("_x") / max(2 * reach, largest * 1e-12, 1e-290)).cast("long")
    a, b = (df.withColumn("_bin", bin_).drop("_x") for df in sides)
    return a, b.withColumn("_bin", F.explode(F.array(*[F.col("_bin") + i for i in (-1, 0, 1)])))


def score_linkage(
    left: DataFrame,
    right: DataFrame,
    score: Callable[[list[str]], Column],
    left_id: str,
    right_id: str,
    columns: Sequence[str] | Mapping[str, Sequence[str]] | None = None,
    k: int = 10,
    block_on: Sequence[str] = (),
    most: int | None = 500_000_000,
    near: Near | None = None,
) -> DataFrame:
    """The k best left-right pairs: left_index, right_index, score, and left_ and right_ canonical columns.

    score gets the canonical names and returns a column over `left_` and `right_` columns. With block_on, pairs must
    agree on one of these canonical columns; without, all left-right pairs are scored if they are `most` or fewer (None: any
    number). Rows of equal values are one class, which is compared once: the best k pairs of rows are among the best k pairs
    of classes, ranked by their smallest ids, and the k smallest ids of each.

    near: classes that follow each other in the order of that column (in blocks, or after the other columns) are scored first.
    The k-th best of them is a lower bound, and only pairs that can reach it meet, in bins of the column; if there aren't k,
    all meet. Without it, pairs grow with the product of both sides' distinct rows.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    if columns is None:
        columns = [c for c in left.columns if c in right.columns and c not in (left_id, right_id)] or None
    named = resolve_linkage_columns(left, right, columns)
    names = [n for n, _, _ in named]
    a = left.select(F.col(left_id).alias("left_index"), *[F.col(x).alias(f"left_{n}") for n, x, _ in named])
    b = right.select(F.col(right_id).alias("right_index"), *[F.col(x).alias(f"right_{n}") for n, _, x in named])
    if not block_on and most is not None and (n := a.count() * b.count()) > most:
        raise ValueError(f"{n} pairs are over the limit of {most}; give block_on")
    a, b = _classes(a, "left_index", k), _classes(b, "right_index", k)

    def apart(pairs: DataFrame, i: int) -> DataFrame:
        """A pair is left to the first rule it agrees on."""
        for earlier in block_on[:i]:
            pairs = pairs.filter(~F.coalesce(F.col(f"left_{earlier}") == F.col(f"right_{earlier}"), F.lit(False)))
        return pairs

    extra: list[str] = []
    if near is not None:
        if block_on:
            first = [apart(_neighbours(a, b, [r, *[near.column] * (r != near.column)]), i).filter(F.col(f"left_{r}") == F.col(f"right_{r}")) for i, r in enumerate(block_on)]
        else:
            first = [_neighbours(a, b, [*[n for n in names if n != near.column], near.column])]
        found = [r["score"] for some in first for r in some.select(score(names).cast("double").alias("score")).filter("score is not null and not isnan(score)").orderBy(F.desc("score")).limit(k).collect()]  # k rows a rule
        reach = near.reach(sorted(found)[-k]) if len(found) >= k else math.inf
        if math.isfinite(reach):
            a, b = _within(a, b, near.column, reach)
            extra = ["_bin"]
    if block_on:
        pairs = None
        for i, rule in enumerate(block_on):
            some = dealt_join(a.withColumn("_key", F.col(f"left_{rule}")), b.withColumn("_key", F.col(f"right_{rule}")), ["_key", *extra], "left_index").drop("_key", *extra)
            some = apart(some, i)
            pairs = some if pairs is None else pairs.unionByName(some)
    elif extra:
        pairs = dealt_join(a, b, extra, "left_index").drop(*extra)
    else:
        pairs = a.repartition(left.sparkSession.sparkContext.defaultParallelism).join(b)
    best = pairs.withColumn("score", score(names)).orderBy(_ranked(), "left_index", "right_index").limit(k)
    scored = best.withColumn("left_index", F.explode("_left_index")).withColumn("right_index", F.explode("_right_index"))
    return scored.select("left_index", "right_index", "score", *[f"{s}_{n}" for n in names for s in ("left", "right")]).orderBy(_ranked(), "left_index", "right_index").limit(k)
