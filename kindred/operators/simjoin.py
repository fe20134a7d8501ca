"""Joins of similar texts that don't compare what can't be similar: sets by Jaccard, and the best k by TF-IDF cosine.

set_join: pairs of sets with a Jaccard similarity of t or more. Elements get one order for all sets, frequent ones last. Two such
sets share an element among the first |x| - ceil(t |x|) + 1 of either (prefixes); their sizes differ by a factor of 1 / t at
most; and their prefixes must share so many that the rest of a set can make up what is missing. What passes is compared
exactly. In class_join, equal sets are one class, so copies make no pairs. Prefixes are shuffled, sets only where they may be similar.

top_k: for each left row the k right rows with the largest dot product. Its rarest grams give some first candidates, whose
k-th score is a lower bound; a row that shares only such grams whose largest weights can't add up to that bound is never
looked at. Candidates are compared exactly, so the result is that of comparing all.

Elements and grams are known by their 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.operators.pairs import dealt_join
from kindred.storage import written


def shingle_sets(records: DataFrame, record_id: str, text: str, words: int = 5) -> DataFrame:
    """(record_id, s): the distinct hashes of a text's runs of words (lower-cased, cut at what isn't a letter or digit), or of
    all its words if they are fewer; of a text without words null."""
    found = records.select(record_id, F.filter(F.split(F.lower(F.col(text)), "[^\\p{L}\\p{N}]+"), lambda w: w != "").alias("_w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("_w") - (words - 1), F.lit(1)))
    # words are taken one by one, as a slice would copy the whole text's for each place; those beyond its end are left out
    runs = F.transform(starts, lambda i: F.xxhash64(F.concat_ws(" ", *[F.get("_w", i + (j - 1)) for j in range(words)])))
    return found.select(record_id, F.when(F.size("_w") > 0, F.array_distinct(runs)).alias("s"))


#: Frequent elements are looked for in so many sets, and there are so many of them at most. They order elements, and leave none out.
_LOOKED, _FREQUENT = 5_000, 1_000
#: Rows whose sets are compared are looked up by a broadcast of their ids, up to so many.
_SENT = 2_000_000
#: Gives the sets (id, s) of those rows, all with an id, that a function of the rows leaves.
Of = Callable[[Callable[[DataFrame], DataFrame]], DataFrame]
#: Gives records with the id of that name their sets.
Make = Callable[[DataFrame, str], DataFrame]


def _frequent(of: Of) -> np.ndarray:
    """The elements that most of some sets hold, rarer ones first."""
    share = max(1, of(lambda rows: rows).select("id").count() // _LOOKED)
    some = of(lambda rows: rows.filter(F.pmod(F.xxhash64("id"), F.lit(share)) == 0))

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).flatten()], names=["e"])

    # taken apart by Arrow, as a filter on what makes the sets would be put below explode(), and make them for each element
    counts = some.select(F.col("s").cast("array<bigint>").alias("s")).mapInArrow(elements, "e bigint").groupBy("e").agg(F.count(F.lit(1)).alias("n")).filter("n > 4")
    return np.array([r["e"] for r in counts.orderBy(F.desc("n"), "e").limit(_FREQUENT).collect()][::-1], np.int64)  # 8 kB


def _kept(n: Column, threshold: float) -> Column:
    """How long the prefix of a set of n elements is."""
    return n - F.ceil(n * F.lit(threshold) - 1e-9).cast("int") + 1


def _prefixes(of: Of, threshold: float) -> DataFrame:
    """id, n, key, prefix of the sets (id, s) with elements: size, digest of the set, its first elements. Whole sets stay in their tasks."""
    sets, often = of(lambda rows: rows), _frequent(of)
    by = np.argsort(often, kind="stable")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sizes, keys, prefixes, column = [], [], [], [], batch.column(1)
            values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            for i in np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False)):
                own = np.sort(values[offsets[i] : offsets[i + 1]])
                n = len(own)
                if n:
                    kept = n - math.ceil(n * threshold - 1e-9) + 1
                    # any order of elements gives the same pairs; frequent ones meet least where they come last, rarer ones first
                    place = by[np.minimum(np.searchsorted(often[by], own), len(often) - 1)] if len(often) else np.zeros(n, int)
                    hot = often[place] == own if len(often) else np.zeros(n, bool)
                    rows.append(i)
                    sizes.append(n)
                    keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    prefixes.append(np.concatenate([own[~hot], often[np.sort(place[hot])]])[:kept])
            ends = np.cumsum([0, *map(len, prefixes)])
            flat = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *prefixes])))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int32()), pa.array(keys, pa.binary()), flat], names=["id", "n", "key", "prefix"])

    kind = sets.schema["id"].dataType.simpleString()
    return written(sets.select("id", F.col("s").cast("array<bigint>").alias("s")).mapInArrow(work, f"id {kind}, n int, key binary, prefix array<bigint>"), "prefixes")


def _candidates(prefixes: DataFrame, threshold: float) -> DataFrame:
    """left_id, right_id of sets that can be similar, by what their prefixes (id, n, prefix) share; those of left are no larger."""
    # an element in one prefix alone meets nothing; all rows of an element are counted where they come together
    elements = prefixes.select(F.explode("prefix").alias("e"), "id", "n")
    counted = elements.withColumn("sets", F.count(F.lit(1)).over(Window.partitionBy("e"))).filter("sets > 1").drop("sets")
    shared = written(counted, "shared-elements")
    # sizes are put into classes by powers of 1 / threshold, so similar sets are in one class or in neighbouring ones
    level = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / threshold) + 1e-9).cast("int") if threshold < 1 else F.col("n")
    rows = shared.withColumn("level", level)
    right = rows.select("e", "level", F.col("id").alias("right_id"), F.col("n").alias("right_n"))
    reach = [0, 1] if threshold < 1 else [0]
    left = rows.select("e", F.explode(F.array(*[F.col("level") + i for i in reach])).alias("level"), F.col("id").alias("left_id"), F.col("n").alias("left_n"))
    met = dealt_join(left, right, ["e", "level"], "left_id")
    met = met.filter((F.col("left_n") < F.col("right_n")) | (F.col("left_n") == F.col("right_n")) & (F.col("left_id") < F.col("right_id")))
    found = met.filter(F.col("left_n") >= F.col("right_n") * threshold - 1e-9).groupBy("left_id", "right_id", "left_n", "right_n").agg(F.count(F.lit(1)).alias("common"))
    # what the prefix that ends first holds of the other set is in the other's prefix, so the rest of that set is all there can be besides
    rest = F.greatest(*[F.col(c) - _kept(F.col(c), threshold) for c in ("left_n", "right_n")])
    least = F.ceil((F.col("left_n") + F.col("right_n")) * (threshold / (1 + threshold)) - 1e-9)
    return written(found.filter(F.col("common") + rest >= least).select("left_id", "right_id"), "candidates")


def _compared(candidates: DataFrame, of: Of, threshold: float) -> DataFrame:
    """left_id, right_id, similarity of the candidates that reach the threshold; only their sets are shuffled."""
    ids = candidates.select(F.explode(F.array("left_id", "right_id")).alias("id")).distinct()
    ids = written(ids, "candidate-ids")
    asked = F.broadcast(ids) if ids.count() <= _SENT else ids
    some = written(of(lambda rows: rows.join(asked, "id", "left_semi")).select("id", "s"), "candidate-sets")
    named = candidates.join(some.select(F.col("id").alias("left_id"), F.col("s").alias("a")), "left_id").join(some.select(F.col("id").alias("right_id"), F.col("s").alias("b")), "right_id")
    shared = named.select("left_id", "right_id", (F.size("a") + F.size("b")).alias("n"), F.size(F.array_intersect("a", "b")).alias("shared"))
    found = shared.withColumn("similarity", F.col("shared") / (F.col("n") - F.col("shared"))).filter(F.col("similarity") >= threshold - 1e-12)
    return found.select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"), "similarity")


def _checked(threshold: float) -> None:
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0, and 1 at most")


def set_join(sets: DataFrame, threshold: float = 0.8) -> DataFrame:
    """left_id, right_id, similarity of all pairs of sets (id, s: arrays of distinct longs) that reach the threshold."""
    _checked(threshold)
    of = lambda some: some(sets).select("id", "s")
    return _compared(_candidates(_prefixes(of, threshold), threshold), of, threshold)


def class_join(records: DataFrame, record_id: str, elements: str, threshold: float = 0.8, make: Make | None = None) -> tuple[DataFrame, DataFrame]:
    """set_join of the distinct sets of records, and membership (record_id, id). A class of equal sets has the smallest id of its
    rows; rows without elements are in none. make: gives sets (elements) of some records with that id, if they have none yet;
    they are made anew for those that are compared, and the others' aren't kept."""
    _checked(threshold)
    rows = records.withColumnRenamed(record_id, "id").filter("id is not null")
    of = lambda some: (make(some(rows), "id") if make else some(rows)).select("id", F.col(elements).alias("s"))
    prefixes = _prefixes(of, threshold)
    first = written(prefixes.groupBy("n", "key").agg(F.min("id").alias("class")), "classes")
    members = prefixes.select("id", "n", "key").join(first, ["n", "key"]).select(F.col("id").alias(record_id), F.col("class").alias("id"))
    candidates = _candidates(prefixes.select("id", "n", "prefix").join(first.select(F.col("class").alias("id")), "id", "left_semi"), threshold)
    return _compared(candidates, of, threshold), members


def near_copies(records: DataFrame, record_id: str, elements: str, threshold: float = 0.8, make: Make | None = None) -> DataFrame:
    """One row per record: record_id, component_id (the smallest id it is linked with, over any number of links) and links (the
    distinct other sets it is similar to). Records without elements are alone. make: as in class_join."""
    from kindred.operators.graph import component_labels

    pairs, members = class_join(records, record_id, elements, threshold, make)
    pairs, members = written(pairs, "similar-sets"), written(members, "members")
    links = pairs.select(F.col("left_id").alias("id")).union(pairs.select("right_id")).groupBy("id").agg(F.count(F.lit(1)).alias("links"))
    found = component_labels(members.select("id").distinct(), pairs, "id").join(links, "id", "left")
    named = members.join(found, "id").select(F.col(record_id).alias("_id"), "component_id", "links")
    out = records.select(record_id).join(named, F.col(record_id) == F.col("_id"), "left")
    return out.select(record_id, F.coalesce("component_id", record_id).alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


# -- the best k by dot product ------------------------------------------------------------------------------------


def _vectors(weights: DataFrame, side: str) -> DataFrame:
    """One row per id: its grams' hashes in order, and their weights."""
    rows = weights.groupBy(side).agg(F.sort_array(F.collect_list(F.struct(F.xxhash64("gram").alias("g"), "w"))).alias("v"))
    return rows.select(side, F.transform("v", lambda x: x["g"]).alias(f"g_{side}"), F.transform("v", lambda x: x["w"]).alias(f"w_{side}"))


def _scored(candidates: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Add score, the dot product of both sides' vectors, to pairs (left_id, right_id)."""
    kinds = {c: left.schema[c].dataType.simpleString() if c in left.columns else right.schema[c].dataType.simpleString() for c in ("left_id", "right_id")}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.zeros(len(batch))
            columns = [batch.column(i) for i in range(2, 6)]
            offsets = [c.offsets.to_numpy() for c in columns]
            values = [c.values.to_numpy() for c in columns]
            for i in range(len(batch)):
                a, v, b, w = (x[o[i] : o[i + 1]] for x, o in zip(values, offsets))
                if len(a) and len(b):
                    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                    same = b[at] == a
                    scores[i] = v[same] @ w[at[same]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores)], names=["left_id", "right_id", "score"])

    joined = candidates.join(left, "left_id").join(right, "right_id").select("left_id", "right_id", "g_left_id", "w_left_id", "g_right_id", "w_right_id")
    return joined.mapInArrow(work, f"left_id {kinds['left_id']}, right_id {kinds['right_id']}, score double")


def top_k(left: DataFrame, right: DataFrame, k: int, digits: int = 9, first: int = 4) -> DataFrame:
    """left_id, right_id, rank, score, compared: the k right rows with the largest score above 0 for each left row.

    left: (left_id, gram, w), right: (right_id, gram, w), with a row per id and gram and weights above 0. Ties (of scores
    rounded to `digits`) are broken by right_id. compared: how many right rows the left row was compared with. The first
    candidates come from its rarest grams, until those are in `first` * k right rows.
    """
    right = written(right, "right-weights")
    grams = right.groupBy("gram").agg(F.count(F.lit(1)).alias("df"), F.max("w").alias("most"))
    per_row = Window.partitionBy("left_id").orderBy("df", "gram")
    looked = left.join(grams, "gram").withColumn("before", F.sum("df").over(per_row) - F.col("df"))
    # what this gram and all more frequent ones can add to a score
    looked = looked.withColumn("can", F.sum(F.col("w") * F.col("most")).over(Window.partitionBy("left_id").orderBy(F.col("df").desc(), F.col("gram").desc())))
    looked = written(looked.select("left_id", "gram", "w", "before", "can"), "left-weights")
    lists = right.select("gram", "right_id")
    lv, rv = written(_vectors(looked, "left_id"), "left-vectors"), written(_vectors(right, "right_id"), "right-vectors")
    pairs = lambda some: dealt_join(some.select("gram", "left_id"), lists, ["gram"], "left_id").select("left_id", "right_id").distinct()
    rare = written(pairs(looked.filter(F.col("before") < first * k)), "first-candidates")
    scored = written(_scored(rare, lv, rv), "first-scores")
    rank = F.row_number().over(Window.partitionBy("left_id").orderBy(F.round("score", digits).desc(), "right_id"))
    bounds = scored.withColumn("rank", rank).filter(F.col("rank") == k).select("left_id", F.col("score").alias("bound"))
    open_ = looked.filter(F.col("before") >= first * k).join(bounds, "left_id", "left").filter(F.col("can") >= F.coalesce("bound", F.lit(0.0)) - 10.0**-digits)
    more = pairs(open_).join(rare, ["left_id", "right_id"], "left_anti")
    every = written(scored.unionByName(_scored(more, lv, rv)), "scores")
    ranked = every.withColumn("rank", rank).withColumn("compared", F.count(F.lit(1)).over(Window.partitionBy("left_id")))
    return ranked.filter((F.col("rank") <= k) & (F.col("score") > 0)).select("left_id", "right_id", "rank", "score", "compared")
