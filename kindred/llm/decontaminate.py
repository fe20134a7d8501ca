"""Benchmark decontamination with a generalised suffix automaton of the benchmark's items.

The automaton of all items (over word numbers) is small next to the corpus: it is built on the driver in shards of
bounded size, and documents stream through it. While words are read, the automaton's state is the longest suffix of
what was read that occurs in some item. A document word is hit if it lies inside an occurrence of a window: `window`
consecutive words of an item, or the whole of an item that is shorter.

A state takes about 24 bytes in arrays, and its moves after the first about 100 more. Shards of a benchmark larger than
one shard are files in the shared folder; each task reads its texts once, and each batch of them goes through the shards
one after the other, so that a worker holds one shard at a time and the corpus is neither shuffled nor written. An item
is never split: a single one that is longer than a shard makes a shard of its own.

Definitions for odd input: a null or empty text has no words and no hits; an item without words has no window; rows
with equal ids are judged one by one; a null item id counts as the empty string, and items that share an id are one;
an empty benchmark hits nothing; an empty table gives an empty result; texts of any length are read whole, one at a
time. Other columns of both tables are not read, so their names may clash.
"""

from __future__ import annotations

import pickle
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.files import open_fs
from kindred.llm.shared import add_arrow, raw, scratch

#: Bytes of words: A-Z become lower case, other ASCII that isn't a digit or letter becomes a space.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

#: Words of items in one automaton.
SHARD_WORDS = 250_000


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORDS).split() if text else []


class SuffixAutomaton:
    """All substrings of several word sequences, and which items hold their windows."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.link, self.length = array("i", [-1]), array("i", [0])
        #: Each state's first move, by word and state (0: none); further moves are in dictionaries by state.
        self.word, self.next = array("i", [0]), array("i", [0])
        further: dict[int, dict[int, int]] = {}
        items = [(name, words) for name, words in items if words]
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(further, last, self.vocabulary.setdefault(w, len(self.vocabulary) + 1))
        self.base = len(self.vocabulary) + 1
        self.moves = {s * self.base + w: t for s, x in further.items() for w, t in x.items()}
        n = len(self.link)
        by_length = np.argsort(np.frombuffer(self.length, np.int32), kind="stable")[1:].tolist()
        #: The state of the last `window` words of what a state stands for.
        self.cut = array("i", bytes(4 * n))
        for s in by_length:
            if self.length[s] >= window:
                up = self.link[s]
                self.cut[s] = self.cut[up] if self.length[up] >= window else s
        #: An item that holds a window, and the others of windows that several hold.
        self.holder, self.holders = array("i", [-1]) * n, {}
        short: dict[int, dict[int, set[int]]] = {}
        for name, words in items:
            s, who = 0, number[name]
            for i, w in enumerate(words):
                s = self.step(s, self.vocabulary[w])
                if i + 1 >= window:
                    at = self.cut[s]
                    if self.holder[at] < 0:
                        self.holder[at] = who
                    elif self.holder[at] != who:
                        self.holders.setdefault(at, set()).add(who)
            if len(words) < window:
                short.setdefault(s, {}).setdefault(len(words), set()).add(who)
        #: Short items that end where a state ends: (words, items), of the state and of all its suffixes.
        self.short: dict[int, tuple[tuple[int, frozenset[int]], ...]] = {}
        for s in by_length if short else ():
            own = tuple((m, frozenset(x)) for m, x in short.get(s, {}).items())
            if found := own + self.short.get(self.link[s], ()):
                self.short[s] = found
        #: A run of fewer known words can't hold a window.
        self.least = min([window, *(len(words) for _, words in items)])

    def step(self, s: int, w: int) -> int | None:
        """Where a word leads from a state."""
        return self.next[s] if self.word[s] == w else self.moves.get(s * self.base + w)

    def _move(self, further: dict[int, dict[int, int]], s: int, w: int) -> int:
        """As step(), while the automaton is made; 0 if the word leads nowhere."""
        return self.next[s] if self.word[s] == w else further[s].get(w, 0) if s in further else 0

    def _set(self, further: dict[int, dict[int, int]], s: int, w: int, t: int) -> None:
        if self.word[s] in (0, w):
            self.word[s], self.next[s] = w, t
        else:
            further.setdefault(s, {})[w] = t

    def _state(self, link: int, length: int) -> int:
        for column, value in ((self.link, link), (self.length, length), (self.word, 0), (self.next, 0)):
            column.append(value)
        return len(self.link) - 1

    def _extend(self, further: dict[int, dict[int, int]], last: int, word: int) -> int:
        link, length = self.link, self.length
        if q := self._move(further, last, word):
            return q if length[q] == length[last] + 1 else self._split(further, last, word, q)
        new, p = self._state(0, length[last] + 1), last
        while p >= 0 and not (q := self._move(further, p, word)):
            self._set(further, p, word, new)
            p = link[p]
        if p >= 0:
            link[new] = q if length[q] == length[p] + 1 else self._split(further, p, word, q)
        return new

    def _split(self, further: dict[int, dict[int, int]], p: int, word: int, q: int) -> int:
        """A copy of q for the shorter strings that p leads to."""
        copy = self._state(self.link[q], self.length[p] + 1)
        self.word[copy], self.next[copy] = self.word[q], self.next[q]
        if q in further:
            further[copy] = dict(further[q])
        self.link[q] = copy
        while p >= 0 and self._move(further, p, word) == q:
            self._set(further, p, word, copy)
            p = self.link[p]
        return copy

    def scan(self, words: list[bytes]) -> tuple[list[int], set[int], int]:
        """Where hit words are (start, stop, start, stop ...), the items with occurring windows, and the longest match."""
        spans: list[int] = []
        items: set[int] = set()
        longest = 0
        if not self.names:
            return spans, items, longest
        get, move, link, length = self.vocabulary.get, self.moves.get, self.link, self.length
        first, then, base = self.word, self.next, self.base
        numbers = [get(w, 0) for w in words]
        known = np.flatnonzero(np.diff(np.array([0, *numbers, 0]) > 0))
        for start, stop in zip(known[::2].tolist(), known[1::2].tolist()):
            if stop - start < self.least:
                continue
            s = matched = 0
            for i in range(start, stop):
                w = numbers[i]
                t = then[s] if first[s] == w else move(s * base + w)
                while t is None and s:
                    s = link[s]
                    matched = length[s]
                    t = then[s] if first[s] == w else move(s * base + w)
                if t is None:
                    s = matched = 0
                    continue
                s, matched = t, matched + 1
                if matched > longest:
                    longest = matched
                hit = 0
                if matched >= self.window:
                    # the state's longest string may be longer than what was matched, but its cut holds the same window
                    at = self.cut[s]
                    items.add(self.holder[at])
                    if at in self.holders:
                        items |= self.holders[at]
                    hit = self.window
                for m, who in self.short.get(s, ()) if self.short else ():
                    if m <= matched:
                        items |= who
                        hit = max(hit, m)
                if hit:
                    a = i + 1 - hit
                    while spans and spans[-1] >= a:
                        a = min(a, spans[-2])
                        del spans[-2:]
                    spans += [a, i + 1]
        return spans, items, longest


def _merged(a: list[int], b: list[int]) -> list[int]:
    """Two lists of spans as one."""
    out: list[int] = []
    for start, stop in sorted([*zip(a[::2], a[1::2]), *zip(b[::2], b[1::2])]):
        if out and out[-1] >= start:
            out[-1] = max(out[-1], stop)
        else:
            out += [start, stop]
    return out


def _shards(benchmark: DataFrame, item: str, text: str, most: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in shards of bounded size; the driver holds one at a time."""
    shard, size = [], 0
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")), F.col(text)).toLocalIterator()
    for name, value in rows:
        words = words_of(value.encode() if value else None)
        if shard and size + len(words) > most:
            yield shard
            shard, size = [], 0
        shard.append((name, words))
        size += len(words)
    yield shard


def _machines(spark: SparkSession, benchmark: DataFrame, window: int, item: str, text: str, most: int) -> tuple[Callable[[], Iterator[SuffixAutomaton]], bool]:
    """Make the automata; what is returned gives them to a worker one by one, and tells if there is one only."""
    shards = _shards(benchmark, item, text, most)
    one, after = pickle.dumps(SuffixAutomaton(next(shards), window)), next(shards, None)
    if after is None:
        shared = spark.sparkContext.broadcast(one)  # of a shard, whose size is bounded
        return (lambda: iter([pickle.loads(shared.value)])), True
    folder, paths = scratch(spark, "automata"), []
    while one is not None:
        system, place = open_fs(f"{folder}/{len(paths)}")
        system.create_dir(place.rpartition("/")[0], recursive=True)
        with system.open_output_stream(place) as out:
            out.write(one)
        paths.append(f"{folder}/{len(paths)}")
        one = None if after is None else pickle.dumps(SuffixAutomaton(after, window))
        after = next(shards, None)

    def each() -> Iterator[SuffixAutomaton]:
        for path in paths:
            system, place = open_fs(path)
            with system.open_input_stream(place) as stream:
                yield pickle.loads(stream.read())

    return each, False


FOUND = "n_words int, spans array<int>, items array<string>, longest int"


def with_match(docs: DataFrame, benchmark: DataFrame, name: str, window: int = 13, text: str = "text", item_id: str = "item_id", item_text: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """Add a column of FOUND: the number of words, spans of hit words (merged), items (sorted as strings), longest match."""
    machines, single = _machines(docs.sparkSession, benchmark, window, item_id, item_text, shard_words)

    def work(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kept = next(machines()) if single else None
        for texts in arrays:
            found: list[list] | None = None
            for machine in [kept] if single else machines():
                out: list[list] = [[], [], [], []]
                for i, value in enumerate(raw(texts)):
                    words = words_of(value)
                    spans, who, best = machine.scan(words)
                    names = {machine.names[j] for j in who}
                    if found is not None:
                        spans, names, best = _merged(found[1][i], spans) if found[1][i] else spans, names.union(found[2][i]), max(best, found[3][i])
                    for column, x in zip(out, (len(words), spans, sorted(names), best)):
                        column.append(x)
                found = out
            yield pa.StructArray.from_arrays([pa.array(found[0], pa.int32()), pa.array(found[1], pa.list_(pa.int32())), pa.array(found[2], pa.list_(pa.string())), pa.array(found[3], pa.int32())], names=["n_words", "spans", "items", "longest"])

    return add_arrow(docs, name, work, FOUND, F.col(text).cast("string"))


def match(docs: DataFrame, benchmark: DataFrame, window: int = 13, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", keep_text: bool = False, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per document: its id, the text if kept, and the columns of FOUND."""
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text"))
    found = with_match(rows, benchmark, "_found", window, "_text", item_id, item_text, shard_words)
    return found.select(F.col("_id").alias(doc_id), *[F.col("_text").alias(text)] * keep_text, "_found.*")


def _hit_words(spans: Column) -> Column:
    signed = F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x).cast("long"))
    return F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x)


def contaminated(found: Column, one_in: int = 20) -> Column:
    """Of a column of FOUND: some word is hit, and one in `one_in` words or more are."""
    n_hit = _hit_words(found["spans"])
    return (n_hit > 0) & (n_hit * one_in >= found["n_words"])


def judge(matches: DataFrame, one_in: int = 20) -> DataFrame:
    """Add n_hit, n_items, items_sha256 and contaminated (see there)."""
    return (
        matches.withColumn("n_words", F.col("n_words").cast("long"))
        .withColumn("n_hit", _hit_words(F.col("spans")))
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words")))
    )


def excise(docs: DataFrame, benchmark: DataFrame, min_words: int = 13, one_in: int = 20, doc_id: str = "doc_id", text: str = "text", window: int = 13) -> DataFrame:
    """Clean a corpus: contaminated documents go (see judge); from others, hit spans of `min_words` words or more are cut out.

    Returns id, text, n_hit, removed_words. Cut places become one space; texts without such spans stay as they are.
    """
    judged = judge(match(docs, benchmark, window, doc_id, text, keep_text=True), one_in).filter(~F.col("contaminated"))
    judged = judged.select(doc_id, F.struct(F.col(text).alias("text"), "spans").alias("_both"), "n_hit")

    def work(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        word = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
        for both in arrays:
            texts, removed = [], []
            for value, spans in zip(raw(both.field("text")), both.field("spans").to_pylist()):
                cuts = [(a, b) for a, b in zip(spans[::2], spans[1::2]) if b - a >= min_words]
                removed.append(sum(b - a for a, b in cuts))
                if cuts:
                    places = [m.span() for m in word.finditer(value)]
                    at, parts = 0, []
                    for a, b in cuts:
                        parts.append(value[at : places[a][0]].rstrip())
                        at = places[b - 1][1]
                    value = b" ".join([*parts, value[at:].lstrip()]).strip()
                texts.append(None if value is None else value.decode())
            yield pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(removed, pa.int64())], names=["text", "removed_words"])

    out = add_arrow(judged, "_cut", work, "text string, removed_words long", F.col("_both"))
    return out.select(doc_id, F.col("_cut.text").alias(text), "n_hit", "_cut.removed_words")
