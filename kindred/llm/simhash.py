"""SimHash near-duplicates by anchor-point covering.

A fingerprint's 64 bits are split into blocks. With three blocks (of 22, 21 and 21 bits), two fingerprints that differ
in four bits or fewer differ in one bit at most in some block; with two blocks of 32, in two at most. In each block,
anchors are the words of a covering code with radius 1: the perfect Hamming code of 15 (or 31) bits, times all words of
the bits that remain. A fingerprint's home is its nearest anchor, and it also visits every anchor within the covering
radius plus the block's threshold. So the homes of an anchor meet all visitors that may be linked to them there, and are
compared by whole fingerprints: either layout finds every link. (A covering code of all 64 bits at once would need over
100,000 anchors for each fingerprint, or anchors so few that most fingerprints share one.)

The coarse layout has 5 * 2 ** 17 anchors and 45 visits a fingerprint, the fine one 2 ** 28 and 342. Comparisons grow with
visits times fingerprints by anchors; from FINE distinct fingerprints on, the fine layout's are fewer by a factor of 60
and worth its visits.

Equal fingerprints are one node. An anchor that more than CHUNK call home is dealt over several tasks: its homes in
chunks of about that size, its visitors sent to each. A task holds the homes of an anchor while its visitors stream by,
and reports only a spanning forest of the links it finds.

Definitions for odd input: null and empty texts have the fingerprint zero, linked like any other; a text of fewer
words than a shingle is one shingle; rows with a null id are left out of components and get none; rows with equal ids
count as one document each with its own fingerprint; texts of any length are read whole; an empty table gives an empty
result; other columns are not read, so their names may clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.shared import add_arrow, drop_tables, lookup, map_arrow, raw, written
from kindred.operators.graph import connected_components

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class Layout(NamedTuple):
    """Lowest bit and width of each block, bits of the Hamming code in each, and how far anchors are visited."""

    blocks: tuple[tuple[int, int], ...]
    code: int
    reach: int


COARSE, FINE_LAYOUT, WIDE = Layout(((0, 22), (22, 21), (43, 21)), 15, 2), Layout(((0, 32), (32, 32)), 31, 3), Layout(((0, 22), (22, 21), (43, 21)), 15, 3)
#: Distinct fingerprints from which the fine layout costs less.
FINE = 1 << 26
#: Homes of an anchor that are compared together, and rows that a task holds besides.
CHUNK, HELD = 2048, 500_000


def fingerprint(text: bytes | None, words: int = 4) -> int:
    """64-bit SimHash of word shingles: a bit is set if it is in over half of the shingles' hashes."""
    import xxhash

    tokens = text.translate(_LOWER).split() if text else []
    if not tokens:
        return 0
    flat = b" ".join(tokens)
    n = max(1, len(tokens) - words + 1)
    if n == 1:
        hashes = [xxhash.xxh64_intdigest(flat, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
        starts = [0, *(ends[: n - 1] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(flat[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist())]
    total = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        some = np.array(hashes[at : at + (1 << 16)], "<u8")
        total += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((total * 2 > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """The id and fp, a fingerprint as a signed long."""

    def work(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in arrays:
            yield pa.array(np.fromiter((fingerprint(x, words) for x in raw(texts)), np.uint64, len(texts)).view(np.int64))

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    return add_arrow(rows, "fp", work, "long", F.col("text")).select(F.col("id").alias(doc_id), "fp")


def _syndromes(values: np.ndarray, code: int) -> np.ndarray:
    """The Hamming syndrome of the low bits: the exclusive or of the places (from 1) of set bits."""
    s = np.zeros(len(values), np.int64)
    for place in range(code):
        s ^= ((values >> place) & 1) * (place + 1)
    return s


def homes(values: np.ndarray, code: int) -> np.ndarray:
    """The nearest codeword of block values: at distance 0 or 1."""
    s = _syndromes(values, code)
    return np.where(s > 0, values ^ (1 << np.maximum(s - 1, 0)), values)


def anchors_within(values: np.ndarray, width: int, code: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """All codewords at distance `reach` (3 at most) or less: (row, codeword), each once.

    Flipped bits are some of the code's, whose places have the syndrome as their exclusive or, and some of the others.
    """
    s = _syndromes(values, code)
    every = np.arange(len(values))
    # flips in the code's bits, by their number: rows and what is flipped
    low: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(4)]
    exact, other = every[s == 0], every[s > 0]
    low[0].append((exact, np.zeros(len(exact), np.int64)))
    low[1].append((other, 1 << (s[other] - 1)))
    for fixed in (1, 2) if reach > 2 else (1,):
        for places in combinations(range(1, code + 1), fixed):
            last = s.copy()
            for p in places:
                last ^= p
            good = every[(last > places[-1]) & (last <= code)]
            low[fixed + 1].append((good, sum(1 << (p - 1) for p in places) | (1 << (last[good] - 1))))
    rows, words = [], []
    for n, found in enumerate(low[: reach + 1]):
        row, flip = np.concatenate([x for x, _ in found] or [every[:0]]), np.concatenate([x for _, x in found] or [every[:0]])
        for m in range(reach - n + 1):
            for bits in combinations(range(code, width), m):
                rows.append(row)
                words.append(values[row] ^ flip ^ sum(1 << b for b in bits))
    return np.concatenate(rows), np.concatenate(words)


class _Forest:
    """Union-find that keeps the links that joined something."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _spanning(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Fewer links, of one node each, that connect what the given ones connect."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(names))
    while len(left):
        least = np.minimum(label[left], label[right])
        np.minimum.at(label, label[left], least)
        np.minimum.at(label, label[right], least)
        while (label[label] != label).any():
            label = label[label]
        open_ = label[left] != label[right]
        left, right = left[open_], right[open_]
    some = np.flatnonzero(label != np.arange(len(names)))
    return list(zip(names[some].tolist(), names[label[some]].tolist()))


def _blocks(fp: np.ndarray, layout: Layout) -> Iterator[tuple[int, int, np.ndarray]]:
    """Number, width and values of each block."""
    for k, (low, width) in enumerate(layout.blocks):
        yield k << 40, width, ((fp >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)


def links(prints: DataFrame, most: int = 4, layout: Layout | None = None) -> DataFrame:
    """Links (left_id, right_id) between distinct fingerprints (column fp) that connect all that differ in `most` bits or fewer.

    Five bits at most leave one of three blocks with one, or one of two with two; up to eight leave one of three with two,
    which takes 308 visits.
    """
    layout = layout or (WIDE if most > 5 else COARSE if prints.count() < FINE else FINE_LAYOUT)
    if not 0 <= most < len(layout.blocks) * layout.reach:
        raise ValueError(f"these anchors find links of {len(layout.blocks) * layout.reach - 1} bits at most")

    def own_homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, _, values in _blocks(batch.column(0).to_numpy().view(np.uint64), layout):
                yield pa.RecordBatch.from_arrays([pa.array(homes(values, layout.code) | k)], names=["anchor"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 5_000):
                signed = batch.column(0).slice(start, 5_000).to_numpy()
                for k, width, values in _blocks(signed.view(np.uint64), layout):
                    home = homes(values, layout.code)
                    row, anchor = anchors_within(values, width, layout.code, layout.reach)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor | k), pa.array(signed[row]), pa.array(anchor == home[row])], names=["anchor", "fp", "home"])

    at_home = map_arrow(prints.select("fp"), own_homes, "anchor long")
    # an anchor that many call home has chunks; its homes go to one each, visitors (and those homes again, as such) to all
    crowded = written(at_home.groupBy("anchor").count().filter(F.col("count") > CHUNK).select("anchor", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks")), "crowded-anchors")
    visits = map_arrow(prints.select("fp"), visit, "anchor long, fp long, home boolean")
    if crowded.isEmpty():
        dealt, key = visits, ["anchor"]
    else:
        n = F.coalesce("chunks", F.lit(1))
        joined = visits.join(crowded, "anchor", "left").withColumn("chunk", F.explode(F.sequence(F.lit(0), n - 1)))
        dealt, key = joined.select("anchor", "fp", (F.col("home") & (F.pmod(F.xxhash64("fp"), n) == F.col("chunk"))).alias("home"), "chunk"), ["anchor", "chunk"]
    sent = dealt.repartition(*key).sortWithinPartitions(*key, F.col("home").desc())
    chunk = F.col("chunk") if "chunk" in key else F.lit(0)
    return map_arrow(sent.select("anchor", "fp", "home", chunk.alias("chunk")), _compare(most), "left_id long, right_id long")


def _compare(most: int):
    """Links of homes and visitors that come sorted by anchor, chunk and homes first."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()

        def at_anchors(group: np.ndarray, fp: np.ndarray, home: np.ndarray) -> list[tuple[int, int]]:
            """Compare each home with all rows of its group; groups are sorted numbers."""
            found: list[tuple[int, int]] = []
            edges = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
            sizes = np.diff(edges, append=len(group))
            at_edge = np.repeat(np.arange(len(edges)), sizes)
            who = np.flatnonzero(home)
            at = 0
            while at < len(who):
                costs = np.cumsum(sizes[at_edge[who[at : at + 100_000]]])
                stop = at + max(1, int(np.searchsorted(costs, 2_000_000)))
                some = who[at:stop]
                at = stop
                times = sizes[at_edge[some]]
                left = np.repeat(some, times)
                right = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(edges[at_edge[some]], times)
                close = np.bitwise_count(fp[left] ^ fp[right]) <= most
                close &= fp[left] != fp[right]
                found.extend(e for e in _spanning(fp[left[close]], fp[right[close]]) if forest.join(*e))
            return found

        def linked(held: list[tuple[np.ndarray, ...]]) -> tuple[pa.RecordBatch, tuple[np.ndarray, ...]]:
            """The links of what is held, and the homes of the last anchor, which may have more visitors."""
            anchor, chunk, fp, home = (np.concatenate(x) for x in zip(*held))
            group = np.cumsum((np.diff(anchor, prepend=anchor[0]) != 0) | (np.diff(chunk, prepend=chunk[0]) != 0))
            pairs = np.array(at_anchors(group, fp, home), np.uint64).reshape(-1, 2).view(np.int64)
            last = (group == group[-1]) & home
            if len(forest.up) > 2 * HELD:  # what it forgets may only be reported again
                forest.up.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["left_id", "right_id"]), tuple(x[last] for x in (anchor, chunk, fp, home))

        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(3).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)))
            size += len(batch)
            if size >= HELD:
                out, rest = linked(held)
                held, size = [rest], len(rest[0])
                yield out
        if size:
            yield linked(held)[0]

    return compare


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, most: int = 4) -> DataFrame:
    """One row per row: its id, fingerprint (hexadecimal) and component_id (the smallest id reachable over links)."""
    rows = written(fingerprints(docs, doc_id, text, words).withColumnRenamed(doc_id, "id"), "fingerprints")
    prints = written(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows")), "distinct-fingerprints")
    linked = written(links(prints, most), "links")
    roots = connected_components(linked)
    named = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least", "rows", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    table = written(named.join(least, "root").select("fp", "rows", "component"), "components")
    drop_tables(prints, linked, roots)
    out = lookup(rows, table, "fp", "rows", rows.count())
    return out.select(F.col("id").alias(doc_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("id").isNotNull(), F.col("component")).alias("component_id"))
