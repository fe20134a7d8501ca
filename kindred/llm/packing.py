"""Hierarchical multi-length packing of tokenised documents.

A document's ids (with the end id) are cut into full windows of the longest tier; what remains is routed to the
smallest tier that holds it. Tiers are packed from long to short: each window starts with its tier's longest piece,
and its gap is filled with the largest pieces of shorter tiers that fit; if none fits, one is cut. So windows of all
tiers are full, and only the last ids of a task are left: those go to windows of smaller powers of two. Windows of a
block are then dealt to step groups of about equal token counts and equal mixtures of lengths.

Each task packs its own rows in blocks of bounded size, so nothing is shuffled and no key can be hot. Sequence ids
hold the task's number; they are unique, and the same whenever the table is split into tasks in the same way.

Definitions for odd input: a null or empty text is a document of the end id alone; equal rows, and rows with equal or
null ids, are packed each on its own; pieces of equal length are packed in any order; a text of any length is encoded
whole and cut into windows; an empty table gives no pieces; other columns are not read, so their names may clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.shared import map_arrow, slices
from kindred.llm.tokens import default_path, encoder

TIERS = (2048, 1024, 512, 256)
#: Ids that a task packs together, and ids of a step group.
BLOCK, STEP = 2_000_000, 1 << 16

SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, step_group long"


class TierPacker:
    """Fill windows with pieces (document, start, length); windows are lists of pieces."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tuple(sorted(tiers, reverse=True))
        self.stacks: list[list[tuple[int, int, int]]] = [[] for _ in range(self.tiers[0] + 1)]
        self.mask = 0  # a bit for each length of which there are pieces
        self.windows: list[tuple[int, list[tuple[int, int, int]]]] = []

    def _put(self, piece: tuple[int, int, int]) -> None:
        self.stacks[piece[2]].append(piece)
        self.mask |= 1 << piece[2]

    def _take(self, length: int) -> tuple[int, int, int]:
        piece = self.stacks[length].pop()
        if not self.stacks[length]:
            self.mask ^= 1 << length
        return piece

    def add(self, document: int, length: int) -> None:
        longest = self.tiers[0]
        full = length // longest * longest
        self.windows += [(longest, [(document, start, longest)]) for start in range(0, full, longest)]
        if length > full:
            self._put((document, full, length - full))

    def pack(self) -> None:
        """Fill windows of each tier; less than a window may remain."""
        for tier, below in zip(self.tiers, (*self.tiers[1:], 0)):
            while self.mask >> (below + 1):
                if not self._fill(tier, self.mask.bit_length() - 1):
                    return

    def _fill(self, tier: int, first: int) -> bool:
        window = [self._take(first)]
        gap = tier - first
        while gap:
            if fits := self.mask & ((2 << gap) - 1):
                piece = self._take(fits.bit_length() - 1)
            elif self.mask:  # all are longer: cut the shortest
                document, start, length = self._take((self.mask & -self.mask).bit_length() - 1)
                piece = (document, start, gap)
                self._put((document, start + gap, length - gap))
            else:
                for piece in window:
                    self._put(piece)
                return False
            window.append(piece)
            gap -= piece[2]
        self.windows.append((tier, window))
        return True

    def finish(self) -> None:
        """What remains goes to windows of smaller powers of two."""
        rest = [piece for stack in reversed(self.stacks) for piece in stack]
        self.stacks, self.mask = [[] for _ in self.stacks], 0
        left = sum(p[2] for p in rest)
        size, window, room = 0, [], 0
        while rest:
            if not room:
                size = 1 << (left.bit_length() - 1)
                window, room = [], size
                self.windows.append((size, window))
            document, start, length = rest.pop(0)
            some = min(length, room)
            window.append((document, start, some))
            room -= some
            left -= some
            if length > some:
                rest.insert(0, (document, start + some, length - some))


def step_groups(sizes: list[int], step: int) -> list[int]:
    """Deal windows, longest first and back and forth, to groups of about `step` ids."""
    groups = max(1, -(-sum(sizes) // step))
    out = [0] * len(sizes)
    for k, i in enumerate(sorted(range(len(sizes)), key=lambda i: -sizes[i])):
        turn, at = divmod(k, groups)
        out[i] = groups - 1 - at if turn % 2 else at
    return out


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end: int = 1, tiers: tuple[int, ...] = TIERS, block: int = BLOCK, step: int = STEP) -> DataFrame:
    """One row per piece: the id and the columns of SCHEMA."""
    tokenizer = tokenizer or default_path()
    kind = docs.schema[doc_id].dataType.simpleString()
    tiers = tuple(tiers)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        base = TaskContext.get().partitionId() << 32
        packer = TierPacker(tiers)
        held: dict[int, tuple[object, np.ndarray]] = {}
        number = pending = sequences = groups = 0

        def emit(names: pa.DataType) -> pa.RecordBatch:
            nonlocal packer, held, pending, sequences, groups
            columns: list[list] = [[] for _ in range(9)]
            chosen = step_groups([size for size, _ in packer.windows], step)
            for (size, window), group in zip(packer.windows, chosen):
                offset = 0
                for document, start, length in window:
                    name, ids = held[document]
                    crc = zlib.crc32(ids[start : start + length].astype("<u4").tobytes())
                    for column, value in zip(columns, (name, start, length, crc, len(ids), base + sequences, offset, size, base + groups + group)):
                        column.append(value)
                    offset += length
                sequences += 1
            groups += max(chosen, default=-1) + 1
            packer.windows = []
            held = {p[0]: held[p[0]] for stack in packer.stacks for p in stack}
            pending = 0
            return pa.RecordBatch.from_arrays([pa.array(columns[0], names), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["id", *SCHEMA.replace(" long", "").split(", ")])

        names = None
        for batch in batches:
            names = batch.column(0).type
            for some in slices(batch, 1):
                for name, ids in zip(some.column(0).to_pylist(), encode(pa.concat_arrays([some.column(1)]), end)):
                    held[number] = (name, ids)
                    packer.add(number, len(ids))
                    number += 1
                    pending += len(ids)
                if pending >= block:
                    packer.pack()
                    yield emit(names)
        if names is not None:
            packer.pack()
            packer.finish()
            yield emit(names)

    return map_arrow(docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string")), work, f"id {kind}, {SCHEMA}", encodes=True).withColumnRenamed("id", doc_id)
