"""Token ids in files of fixed-width bit packing.

An id takes the fewest bits that hold the vocabulary. A file:

    magic "KTB1", then 4 little-endian uint32: bits, ids in a full block, documents, blocks
    blocks: ids packed from the lowest bit up into 64-bit words; a block starts at a multiple of 8 bytes
    block offsets: uint64 for each block and one for the end, in bytes from the file's start
    document ids: int64; document starts: int64 for each document and one for the end, in ids
    where the block offsets start: uint64, then magic

So ids i to j are found by reading whole blocks, unpacked by numpy 64 ids abreast. Files hold documents in ascending
order of ids, file after file; the folder's list of files is returned by write() with the ids before each.

Definitions for odd input: a null or empty text is a document of the end id alone; ids must be integers, and the
smallest int64 isn't allowed: a null document id is stored as that, and comes first; rows with equal ids are in the order
of their texts' hashes, so that not even a single id makes a file or a task large; equal rows are in any order; a text of
any length is encoded whole; an empty table gives no files; other columns are not read, so their names may clash.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.llm.files import open_fs
from kindred.llm.shared import map_arrow, scratch, slices
from kindred.llm.tokens import default_path, encoder

MAGIC = b"KTB1"
BLOCK = 1 << 14
NULL_ID = -(1 << 63)
#: Ids that one reading task takes.
READ = 4_000_000


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> np.ndarray:
    """Ids as 64-bit words; 64 ids fill `bits` words."""
    rows = np.zeros((-(-len(ids) // 64), 64), np.uint64)
    rows.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(rows), bits), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        out[:, word] |= rows[:, j] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= rows[:, j] >> np.uint64(64 - shift)
    return out.reshape(-1)


def unpack_bits(words: np.ndarray, bits: int) -> np.ndarray:
    rows = words.reshape(-1, bits)
    out = np.empty((len(rows), 64), np.uint32)
    most = np.uint64((1 << bits) - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        value = rows[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | (rows[:, word + 1] << np.uint64(64 - shift))
        out[:, j] = value & most
    return out.reshape(-1)


class PackedWriter:
    """Write one file; ids of documents come in order."""

    def __init__(self, stream, bits: int, block: int = BLOCK):
        if block % 64:
            raise ValueError("a block holds a multiple of 64 ids")
        self.stream, self.bits, self.block = stream, bits, block
        self.names: list[int] = []
        self.starts = [0]
        self.offsets: list[int] = []
        self.at = 20
        self.waiting: list[np.ndarray] = []
        self.waiting_ids = 0
        stream.write(b"\0" * 20)

    def add(self, name: int | None, ids: np.ndarray) -> None:
        if name == NULL_ID:
            raise ValueError(f"the document id {NULL_ID} stands for null")
        self.names.append(NULL_ID if name is None else name)
        self.starts.append(self.starts[-1] + len(ids))
        self.waiting.append(ids)
        self.waiting_ids += len(ids)
        if self.waiting_ids >= 64 * self.block:
            self._flush(False)

    def _flush(self, rest: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.empty(0, np.uint32)
        stop = len(ids) if rest else len(ids) // self.block * self.block
        for i in range(0, stop, self.block):
            self.offsets.append(self.at)
            data = pack_bits(ids[i : min(i + self.block, stop)], self.bits).astype("<u8").tobytes()
            self.stream.write(data)
            self.at += len(data)
        self.waiting, self.waiting_ids = [ids[stop:]], len(ids) - stop

    def close(self) -> None:
        self._flush(True)
        index = self.at
        self.stream.write(np.array([*self.offsets, self.at], "<u8").tobytes())
        self.stream.write(np.array(self.names, "<i8").tobytes())
        self.stream.write(np.array(self.starts, "<i8").tobytes())
        self.stream.write(struct.pack("<Q4I4s", index, self.bits, self.block, len(self.names), len(self.offsets), MAGIC))
        self.stream.close()


class PackedFile:
    """Random access to one file."""

    def __init__(self, path: str):
        system, place = open_fs(path)
        self.stream = system.open_input_file(place)
        size = self.stream.size()
        index, self.bits, self.block, documents, blocks, magic = struct.unpack("<Q4I4s", self.stream.read_at(28, size - 28))
        if magic != MAGIC:
            raise ValueError(f"not a file of packed ids: {path}")
        rest = self.stream.read_at(size - 28 - index, index)
        self.offsets = np.frombuffer(rest, "<u8", blocks + 1)
        self.names = np.frombuffer(rest, "<i8", documents, 8 * (blocks + 1))
        self.starts = np.frombuffer(rest, "<i8", documents + 1, 8 * (blocks + 1 + documents))

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of this file; only their blocks are read."""
        if start >= stop:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block + 1
        data = self.stream.read_at(int(self.offsets[last] - self.offsets[first]), int(self.offsets[first]))
        return unpack_bits(np.frombuffer(data, "<u8"), self.bits)[start - first * self.block : stop - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


@dataclass(frozen=True)
class Part:
    """A file in a folder's order, and the ids before it."""

    path: str
    documents: int
    ids: int
    before: int


def write(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end: int = 1, block: int = BLOCK) -> list[Part]:
    """Encode and write a table in ascending order of ids, one file per range of ids.

    Attempts of a task write under different names; the list has those that succeeded, so nothing needs to be renamed.
    """
    tokenizer = tokenizer or default_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        encode = encoder(tokenizer)
        task = TaskContext.get().partitionId()
        for batch in batches:
            for some in slices(batch, 1):
                if writer is None:
                    path = f"{folder}/part-{task:06d}-{uuid.uuid4().hex[:8]}.ktb"
                    system, place = open_fs(path)
                    system.create_dir(place.rpartition("/")[0], recursive=True)
                    writer = PackedWriter(system.open_output_stream(place), bits_for(encoder(tokenizer).vocab_size), block)
                for name, ids in zip(some.column(0).to_pylist(), encode.encode(pa.concat_arrays([some.column(1)]), end)):
                    writer.add(name, ids)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"task": [task], "path": [path], "documents": [len(writer.names)], "ids": [writer.starts[-1]]})

    if not isinstance(docs.schema[doc_id].dataType, T.IntegralType):
        raise ValueError(f"document ids must be integers: {doc_id}")
    value = F.col(text).cast("string")
    # places tell rows apart that are equal in id and text; they are of the table as it is read, so a task's second attempt has the same
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), value.alias("text"), F.xxhash64(value).alias("hash"), F.monotonically_increasing_id().alias("place"))
    dealt = rows.repartitionByRange("id", "hash", "place").sortWithinPartitions("id", "hash", "place").select("id", "text")
    found = map_arrow(dealt, work, "task long, path string, documents long, ids long", encodes=True).collect()  # a row for each file
    parts, before = [], 0
    for row in sorted(found, key=lambda r: r["task"]):
        parts.append(Part(row["path"], row["documents"], row["ids"], before))
        before += row["ids"]
    return parts


def read(spark: SparkSession, parts: list[Part], doc_id: str = "doc_id", read_ids: int = READ) -> DataFrame:
    """One row per document: its id, start (ids of all documents before it), n_tokens and ids_crc32."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first, last, before in zip(*(c.to_pylist() for c in batch.columns)):
                file = PackedFile(path)
                starts = file.starts[first : last + 1]
                ids = file.ids(int(starts[0]), int(starts[-1])).astype("<u4")
                cut = (starts - starts[0]).tolist()
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(cut, cut[1:])]
                names = file.names[first:last]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64(), mask=names == NULL_ID), pa.array(before + starts[:-1]), pa.array(np.diff(starts)), pa.array(crcs, pa.int64())],
                    names=["id", "start", "n_tokens", "ids_crc32"],
                )

    # a row for each file; its documents are cut into pieces of about read_ids ids, which are dealt to all tasks
    files = spark.createDataFrame([(p.path, p.documents, p.ids, p.before) for p in parts], "path string, documents long, ids long, before long")
    files = files.withColumn("pieces", F.greatest(F.least(F.col("documents"), F.ceil(F.col("ids") / read_ids)), F.lit(1)))
    cut = files.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    edge = lambda k: F.expr(f"documents * {k} div pieces")
    listed = cut.select("path", edge("k").alias("first"), edge("(k + 1)").alias("last"), "before").repartition("path", "first")
    return map_arrow(listed, work, "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", doc_id)


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write a table's ids to files in the shared folder and read them back."""
    spark = docs.sparkSession
    return read(spark, write(docs, scratch(spark, "tokenbits"), **options))
