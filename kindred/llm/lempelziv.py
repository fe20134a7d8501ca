"""Repeated passages by a relative Lempel-Ziv parse of every document against an index of all that comes earlier.

A document is cut into factors, copies of `window` words or more of something that starts earlier (in a smaller id, or
before it in the same document); the words that no factor covers are literals. The reference is the whole corpus: its
index is sorted by content and cut into blocks, one for each task, and a document is looked up in every block that can
hold one of its factors. The index has two levels, so that it stays smaller than the corpus:

1. Runs. Each window of `window` words has a seed, the leftmost of its SEED-word sequences with the smallest hash.
   Windows of equal words have the same seed at the same place, so only runs with one seed need be compared. A run is
   the windows in a row whose seed is at one place, seven on average; it is indexed by its seed and all its words. A run
   that equals an earlier one is copied whole.
2. Windows. Runs that are the first of their kind, but whose seed also begins other runs, are looked up window by window.

A block is a sorted range of (key, id, start), so a hot passage is spread over many blocks and no group is gathered; who
is first is known from the row before, and the firsts of blocks from the ends of the blocks before them (two rows a block).
The parse is greedy: a factor goes on as long as the next window is indexed one word further on in the same source. Where
it ends, the windows that begin in it and reach over its boundary have been looked up too, so a copy that starts before
the boundary begins a factor that overlaps the last one.

Keys are 128 bits of polynomial hashes of word hashes. Words are `[^\\x20\\x09-\\x0D]+`, unchanged.

Definitions for odd input: a null or empty text has no words; texts shorter than a window have no factors; a null id
comes before all others; rows that share an id are one document laid over itself: of equal windows in them the earlier
start counts as earlier, and at equal starts neither; repeated rows are such rows; texts of any length are read whole, one
at a time; an empty table gives an empty result; other columns are not read, so their names may clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.shared import drop_tables, map_arrow, raw, slices, written

#: Words of a window, and of its seed.
WINDOW, SEED = 20, 8

#: Odd multipliers of the polynomials, and of the mixing of a 64-bit number.
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))

#: What a row of found() is: a copy, a first whose seed has other runs, a first of its block, and the marks of a block's
#: first and last groups.
COPY, OPEN, BEGIN, HEAD, TAIL = range(5)

#: A run's place in one long: its start, its number of windows (4 bits), and 28 bits of the text's hash, which tells rows
#: with one id apart.
_START, _COUNT, _TEXT = 32, 28, (1 << 28) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class _Polynomial:
    """Hashes of any stretch of words, from running sums; they wrap at 64 bits, where an odd base has an inverse."""

    def __init__(self, base: int):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.powers = self.inverses = np.ones(1, np.uint64)

    def sums(self, words: np.ndarray) -> np.ndarray:
        while len(self.powers) <= len(words):
            n = max(len(words) + 1, 1 << 16)
            self.powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, self.base)]))
            self.inverses = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, self.inverse)]))
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * self.powers[: len(words)], dtype=np.uint64)])

    def stretch(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mixed((sums[stop] - sums[start]) * self.inverses[start] + (stop - start).astype(np.uint64))


_polynomials = tuple(map(_Polynomial, _BASES))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of texts as 64-bit hashes in a row, and where each text's begin (and the last ends)."""
    split = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    words = split.values.dictionary_encode()  # the column is a whole array, so its values start at 0
    table = np.array([xxhash.xxh3_64_intdigest(w) for w in raw(words.dictionary)], np.uint64)
    there = pc.binary_length(words.dictionary).to_numpy(zero_copy_only=False) > 0
    index = words.indices.to_numpy()
    kept = there[index] if len(index) else np.zeros(0, bool)
    bounds = np.concatenate([[0], np.cumsum(kept)])[split.offsets.to_numpy()]
    return table[index[kept]] if len(index) else np.zeros(0, np.uint64), bounds


def _leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """Where the smallest of each `width` values in a row is, the leftmost if several are."""
    value, at, have = values, np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        later = value[step:] < value[:-step]
        value, at = np.where(later, value[step:], value[:-step]), np.where(later, at[step:], at[:-step])
        have += step
    return at


def runs_of(words: np.ndarray, bounds: np.ndarray, window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """Of texts: start of each run, number of windows, hash of the seed, hash of all words, text it is in."""
    n = len(words)
    empty = np.zeros(0, np.int64)
    if n < window:
        return empty, empty, empty.view(np.uint64), empty.view(np.uint64), empty
    first, second = (p.sums(words) for p in _polynomials)
    grams = np.arange(n - seed + 1)
    hashes = _polynomials[0].stretch(first, grams, grams + seed)
    at = _leftmost_least(hashes, window - seed + 1)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    fits = np.arange(len(at)) + window <= bounds[owner[: len(at)] + 1]
    begins = fits.copy()
    begins[1:] &= ~fits[:-1] | (at[1:] != at[:-1])
    start = np.flatnonzero(begins)
    count = np.bincount(np.cumsum(begins)[fits] - 1, minlength=len(start))
    return start, count, hashes[at[start]], _polynomials[1].stretch(second, start, start + count + window - 1), owner[start]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(F.lit(_TEXT))


def runs(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """All runs of documents (id, text): k1, k2 (their hashes), id, place (see _START)."""
    if not seed <= window <= seed + 14:
        raise ValueError("a run has 15 windows at most, so seeds may be 14 words shorter than windows")
    kind = docs.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 1):
                words, bounds = word_hashes(some.column(1))
                start, count, k1, k2, owner = runs_of(words, bounds, window, seed)
                place = (start - bounds[owner]) << _START | count << _COUNT | some.column(2).to_numpy()[owner]
                yield pa.RecordBatch.from_arrays([_signed(k1), _signed(k2), some.column(0).take(pa.array(owner)), pa.array(place)], names=["k1", "k2", "id", "place"])

    return map_arrow(docs.select("id", "text", _text_hash(F.col("text")).alias("hash")), work, f"k1 long, k2 long, id {kind}, place long")


def windows(docs: DataFrame, opened: DataFrame, window: int = WINDOW) -> DataFrame:
    """Each window of the opened runs (id, hash, places) as a run of its own."""
    kind = docs.schema["id"].dataType.simpleString()
    keyed = docs.withColumn("hash", _text_hash(F.col("text")))
    some = opened.withColumnsRenamed({"id": "_id", "hash": "_hash"})
    joined = keyed.join(some, keyed["id"].eqNullSafe(some["_id"]) & (keyed["hash"] == some["_hash"])).select("id", "text", "hash", "places")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 1):
                words, bounds = word_hashes(some.column(1))
                sums = [p.sums(words) for p in _polynomials]
                places = some.column(3)
                owner = np.repeat(np.arange(len(some)), pc.list_value_length(places).to_numpy())
                owner, start = _spread(owner, places.flatten().to_numpy())
                at = bounds[owner] + start
                there = at + window <= bounds[owner + 1]
                owner, start, at = owner[there], start[there], at[there]
                keys = [_signed(p.stretch(s, at, at + window)) for p, s in zip(_polynomials, sums)]
                yield pa.RecordBatch.from_arrays([*keys, some.column(0).take(pa.array(owner)), pa.array(start << _START | 1 << _COUNT | some.column(2).to_numpy()[owner])], names=["k1", "k2", "id", "place"])

    return map_arrow(joined, work, f"k1 long, k2 long, id {kind}, place long")


def _spread(owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The owner and the start of each window of runs."""
    count = place >> _COUNT & 15
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(owner, count), np.repeat(place >> _START, count) + within


def found(pieces: DataFrame, name: str) -> DataFrame:
    """Sort pieces (k1, k2, id, place) by content and place, and look each up in its block: rows of a written table.

    kind (see COPY), part (the block), k1 and k2 (of marks only), id, place, source_id, source_start.
    """
    kind = pieces.schema["id"].dataType
    of_id = pieces.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, first_group = TaskContext.get().partitionId(), None, True

        def rows(kinds, k1, k2, ids, place, sources, starts) -> pa.RecordBatch:
            n = len(ids)
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int8()), pa.array(np.full(n, part, np.int32)), k1, k2, ids, place, sources, starts], names=["kind", "part", "k1", "k2", "id", "place", "source_id", "source_start"])

        for batch in batches:
            if not len(batch):
                continue
            # the first row of the last group comes along, so that row 0 begins a group
            table = batch if last is None else pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            k1, k2, place = (table.column(i).to_numpy() for i in (0, 1, 3))
            ids = table.column(2)
            code = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
            start = place >> _START
            begins = np.ones(len(table), bool)
            begins[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
            heads = np.flatnonzero(begins)
            group = np.cumsum(begins) - 1
            lead = heads[group]
            copy = (code != code[lead]) | (start != start[lead])
            # a group is open if one beside it has its seed; the last one of a batch, as that isn't known yet
            seed = k1[heads]
            same = seed[1:] == seed[:-1]
            opened = np.concatenate([[last is not None], same]) | np.concatenate([same, [True]])
            kinds = np.where(copy, COPY, np.where(opened[group], OPEN, -1)).astype(np.int8)
            if first_group:
                kinds[(group == 0) & ~copy] = BEGIN
            if last is None:
                none = pa.nulls(1, ids.type)
                yield rows([HEAD], table.column(0)[:1], table.column(1)[:1], ids[:1], table.column(3)[:1], none, pa.nulls(1, pa.int64()))
            else:
                kinds[0] = -1  # it was given back with its own batch
            first_group = first_group and len(heads) == 1
            some = np.flatnonzero(kinds >= 0)
            no_key = pa.nulls(len(some), pa.int64())
            from_ = pa.array(lead[some])
            yield rows(kinds[some], no_key, no_key, ids.take(pa.array(some)), pa.array(place[some]), ids.take(from_), pa.array(start[lead[some]]))
            last = table.slice(int(heads[-1]), 1)
        if last is not None:
            yield rows([TAIL], last.column(0), last.column(1), last.column(2), last.column(3), pa.nulls(1, last.column(2).type), pa.nulls(1, pa.int64()))

    order = ["k1", "k2", "id", "place"]
    sorted_ = pieces.repartitionByRange(*order).sortWithinPartitions(*order).select(*order)
    table = written(map_arrow(sorted_, work, f"kind byte, part int, k1 long, k2 long, id {of_id}, place long, source_id {of_id}, source_start long"), name)
    # two rows for each block: where its first group began in the blocks before
    marks = table.filter(F.col("kind") >= HEAD).orderBy("part", "kind").select("part", "kind", "k1", "k2", "id", "place").collect()
    carried, before = [], None
    for head, tail in zip(marks[::2], marks[1::2]):
        mine = (head["k1"], head["k2"])
        origin = (head["id"], head["place"] >> _START)
        if before and before[0] == mine:
            if before[1] != origin:
                carried.append((head["part"], *before[1]))
            origin = before[1]
        ends = (tail["k1"], tail["k2"])
        before = (ends, origin if ends == mine else (tail["id"], tail["place"] >> _START))
    rest = table.filter(F.col("kind") < BEGIN).drop("k1", "k2")
    firsts = table.filter(F.col("kind") == BEGIN).drop("k1", "k2")
    if not carried:
        return rest.unionByName(firsts.withColumn("kind", F.lit(OPEN).cast("byte")))
    from pyspark.sql.types import IntegerType, LongType, StructField, StructType

    schema = StructType([StructField("part", IntegerType()), StructField("_id", kind), StructField("_start", LongType())])
    joined = firsts.join(F.broadcast(pieces.sparkSession.createDataFrame(carried, schema)), "part", "left")  # a row a block at most
    copied = F.col("_start").isNotNull()
    solved = joined.select(F.when(copied, COPY).otherwise(OPEN).cast("byte").alias("kind"), "part", "id", "place", F.when(copied, F.col("_id")).otherwise(F.col("source_id")).alias("source_id"), F.coalesce("_start", "source_start").alias("source_start"))
    return rest.unionByName(solved)


def _of(place: Column) -> Column:
    return place.bitwiseAND(F.lit(_TEXT))


def copies(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """What begins earlier elsewhere: one row per copied run of documents (id, text): id, place, source_id, source_start."""
    every = written(runs(docs, window, seed), "runs")
    whole = found(every, "copied-runs")
    drop_tables(every)
    opened = whole.filter(F.col("kind") == OPEN).groupBy("id", _of(F.col("place")).alias("hash")).agg(F.collect_set("place").alias("places"))
    single = written(windows(docs, opened, window), "open-windows")
    cut = found(single, "copied-windows")
    drop_tables(single)
    return whole.unionByName(cut).filter(F.col("kind") == COPY).select("id", "place", "source_id", "source_start")


def factors(starts: np.ndarray, sources: np.ndarray, source_starts: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """A document's factors (start, length, which window its source is that of), of its copied windows in order of start."""
    if not len(starts):
        return []
    ends = np.flatnonzero((np.diff(starts) != 1) | (sources[1:] != sources[:-1]) | (np.diff(source_starts) != 1))
    first = np.concatenate([[0], ends + 1])
    last = np.concatenate([ends, [len(starts) - 1]])
    return list(zip(starts[first].tolist(), (starts[last] - starts[first] + window).tolist(), first.tolist()))


def parse(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """One row per row: its id, n_words, n_removed (words that factors cover), kept (the literals, joined by one space), and
    factors, an array of (start, length, source_id, source_start), all in words."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    own = copies(rows, window, seed).groupBy(F.col("id").alias("_id"), _of(F.col("place")).alias("_hash")).agg(F.collect_set(F.struct("place", "source_id", "source_start")).alias("copied"))
    keyed = rows.withColumn("hash", _text_hash(F.col("text")))
    joined = keyed.join(own, keyed["id"].eqNullSafe(own["_id"]) & (keyed["hash"] == own["_hash"]), "left").select("id", "text", "copied")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 1):
                sizes = pc.list_value_length(some.column(2)).fill_null(0).to_numpy()
                copied = some.column(2).flatten()
                code = copied.field("source_id").dictionary_encode(null_encoding="encode")
                place, source_start, source = copied.field("place").to_numpy(), copied.field("source_start").to_numpy(), code.indices.to_numpy()
                stops = np.cumsum(sizes)
                out: list[list] = [[], [], []]
                lists, starts, lengths, which, from_ = [0], [], [], [], []
                for i, value in enumerate(raw(some.column(1))):
                    words = value.split() if value else []
                    mask = np.zeros(len(words) + 1, np.int64)
                    if sizes[i]:
                        a, b = int(stops[i] - sizes[i]), int(stops[i])
                        run, at = _spread(np.arange(a, b), place[a:b])
                        at, first = np.unique(at, return_index=True)
                        run = run[first]
                        origin = source_start[run] + at - (place[run] >> _START)
                        for start, length, k in factors(at, source[run], origin, window):
                            mask[start] += 1
                            mask[start + length] -= 1
                            starts.append(start)
                            lengths.append(length)
                            which.append(int(source[run[k]]))
                            from_.append(int(origin[k]))
                        covered = np.cumsum(mask[:-1]) > 0
                        kept = [words[j] for j in np.flatnonzero(~covered).tolist()]
                    else:
                        kept = words
                    lists.append(len(starts))
                    for column, x in zip(out, (len(words), len(words) - len(kept), b" ".join(kept))):
                        column.append(x)
                sources = code.dictionary.take(pa.array(which, pa.int32()))
                parts = pa.StructArray.from_arrays([pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), sources, pa.array(from_, pa.int64())], names=["start", "length", "source_id", "source_start"])
                arrays = [some.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()).cast(pa.string()), pa.ListArray.from_arrays(pa.array(lists, pa.int32()), parts)]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "n_words", "n_removed", "kept", "factors"])

    parsed = map_arrow(joined, work, f"id {kind}, n_words long, n_removed long, kept string, factors array<struct<start:long,length:long,source_id:{kind},source_start:long>>")
    return parsed.withColumnRenamed("id", doc_id)
