"""Token counts of documents in flat token files that have no index, by a scan for separators.

A file is little-endian uint16 or uint32 ids; each document ends with the end-of-document id. Files are scanned in
blocks of a fixed number of ids: numpy finds the separators of a block at once, and a prefix scan over the blocks'
summaries (separators, place of the last) tells each block how many documents ended before it and where its first
document began. Tasks look up the files' sizes and list the blocks; the driver holds neither.

Definitions for odd input: ids after a file's last separator are an unterminated document, counted too; an empty file
has no documents; a document of the separator alone has one token; one that spans many blocks is stitched. When the files
are made from a table, a null or empty text is such a document, equal rows, and rows with equal or null ids, are counted
each on its own, a text of any length is encoded whole, an empty table gives an empty result, and other columns are not
read, so their names may clash. A text that has the separator's id is an error; the default is an id that no text has.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.llm.files import open_fs
from kindred.llm.shared import map_arrow, scratch, slices, written
from kindred.llm.tokens import default_path, encoder

#: Ids in a block.
BLOCK = 1 << 20
#: The tokenizer's own end-of-text id, which no text has.
END = 49407


def scan(spark: SparkSession, paths: list[str] | DataFrame, end: int = END, width: int = 2, block: int = BLOCK) -> DataFrame:
    """One row per document: path, ordinal (in its file), start (ids of the file before it), n_tokens (with the end id), terminated.

    paths: a list, or a table with a column path.
    """
    if width not in (2, 4) or not 0 <= end < 1 << 8 * width:
        raise ValueError("ids have 2 or 4 bytes, and the separator is one of them")
    files = spark.createDataFrame([(p,) for p in paths], "path string") if isinstance(paths, list) else paths.select("path")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, place = open_fs(path)
                size = system.get_file_info(place).size // width
                start = np.arange(0, size, block)
                for at in range(0, len(start), 10_000):
                    own = start[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(own)), pa.array(own // block), pa.array(own), pa.array(np.minimum(block, size - own)), pa.array(own + block >= size)], names=["path", "block", "start", "count", "final"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, k, start, count, last in zip(*(c.to_pylist() for c in batch.columns)):
                system, place = open_fs(path)
                with system.open_input_file(place) as stream:
                    ids = np.frombuffer(stream.read_at(count * width, start * width), f"<u{width}")
                stops = np.flatnonzero(ids == end) + (start + 1)
                n = len(stops)
                tail = last and (not n or stops[-1] < start + count)
                yield pa.RecordBatch.from_pydict(
                    {"path": [path], "block": [k], "n": [n], "last": [int(stops[-1]) if n else None], "stops": [[*stops.tolist(), *([start + count] if tail else [])]], "tail": [bool(tail)]},
                    schema=pa.schema([("path", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("last", pa.int64()), ("stops", pa.list_(pa.int64())), ("tail", pa.bool_())]),
                )

    listed = map_arrow(files.repartition("path"), blocks, "path string, block long, start long, count long, final boolean").repartition("path", "block")
    found = written(map_arrow(listed, work, "path string, block long, n long, last long, stops array<long>, tail boolean"), "separators")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = found.select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ended"), F.coalesce(F.max("last").over(before), F.lit(0)).alias("began"))
    joined = found.join(carry, ["path", "block"])
    starts = F.concat(F.array("began"), F.slice("stops", F.lit(1), F.greatest(F.size("stops") - 1, F.lit(0))))
    rows = joined.filter(F.size("stops") > 0).select("path", "ended", "n", "tail", F.posexplode(F.arrays_zip(starts.alias("start"), F.col("stops").alias("stop"))).alias("k", "at"))
    return rows.select("path", (F.col("ended") + F.col("k")).alias("ordinal"), F.col("at.start").alias("start"), (F.col("at.stop") - F.col("at.start")).alias("n_tokens"), (~F.col("tail") | (F.col("k") < F.col("n"))).alias("terminated"))


def write_flat(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end: int = END, width: int = 2) -> DataFrame:
    """Write a table's ids to flat files, one per task; returns which document is where: path, ordinal, id."""
    tokenizer = tokenizer or default_path()
    if max(encoder(tokenizer).vocab_size - 1, end) >= 1 << 8 * width:
        raise ValueError(f"ids of this tokenizer don't fit {width} bytes")
    kind = docs.schema[doc_id].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, ordinal = None, 0
        for batch in batches:
            for some in slices(batch, 1):
                if stream is None:
                    path = f"{folder}/{uuid.uuid4().hex}.tok"
                    system, place = open_fs(path)
                    system.create_dir(place.rpartition("/")[0], recursive=True)
                    stream = system.open_output_stream(place)
                ids, n = np.concatenate(encoder(tokenizer).encode(pa.concat_arrays([some.column(1)]), end)), len(some)
                if np.count_nonzero(ids == end) != n:
                    raise ValueError(f"a text has the separator's id {end}; choose another")
                stream.write(ids.astype(f"<u{width}").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(np.arange(ordinal, ordinal + n)), some.column(0)], names=["path", "ordinal", "id"])
                ordinal += n
        if stream is not None:
            stream.close()

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    return written(map_arrow(rows, work, f"path string, ordinal long, id {kind}", encodes=True), "token-order").withColumnRenamed("id", doc_id)


def count_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end: int = END, width: int = 2, block: int = BLOCK) -> DataFrame:
    """Token counts of a table's documents, by way of flat files: id, n_tokens, path, ordinal, start."""
    spark = docs.sparkSession
    order = write_flat(docs, scratch(spark, "flat"), doc_id, text, tokenizer, end, width)
    counts = scan(spark, order.select("path").distinct(), end, width, block)
    return order.join(counts, ["path", "ordinal"]).select(doc_id, "n_tokens", "path", "ordinal", "start")
