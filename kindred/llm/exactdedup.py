"""Exact deduplication with a log-structured merge index of text digests.

Each task is a memtable: it flushes the digests of its rows as a sorted run, a Parquet file with a Bloom filter on the
digest. Compaction is size-tiered: FANOUT runs of a level become one run of the next, which holds a digest once, with the
smallest identifier of its longest original and the number of rows, until one run is left; a level is one distributed
merge of all its groups of runs. The last run's digests of more than one row are hits. A bitmap of the hits is asked
before any row is sent: rows it doesn't know are alone, and neither they nor their texts move. The texts of hits, and
only those, are compared byte by byte, by grouping them by digest and normalised text. So rows are one group only if
their texts are equal, even if digests should collide. Nothing but DataFrame functions runs.

Texts are normalised by deleting the characters space, tab, line feed, vertical tab, form feed and carriage return.

Definitions for odd input: a null text counts as empty, and empty texts form a group; a null id comes before all
others; of originals of equal length the smallest id stays; rows with equal ids and texts are one group, and all rows
with the kept id are marked as kept; texts of any length are read whole; an empty table gives an empty result; other
columns are not read, so their names may clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.shared import drop_tables, lookup, scratch, written

#: Digests that a run's filter is made for.
FILTER_DIGESTS = 1 << 17
#: Runs of a level that become one run of the next.
FANOUT = 16
#: Bits for each hit of the bitmap that rows pass before they are sent, and its most bits (16 MB): beyond those more
#: rows pass in vain, and none is lost.
HIT_BITS, MOST_BITS = 16, 1 << 27


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", "")


class MergeIndex:
    """Runs of (digest, keep_id, keep_size, rows) in a folder, level by level.

    flush() adds a run to level 0 for each task; compact() merges the runs of all levels to one. In between, digests can
    be looked for. bits: digest length (256; fewer only to test collisions).
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, bits: int = 256, fanout: int = FANOUT):
        self.spark, self.bits, self.fanout = spark, bits, fanout
        self.folder = folder or scratch(spark, "dedup-index")
        self.tables: list[DataFrame] = []
        self.runs = self.flushed = 0
        #: Runs of each level that a compaction has gone through.
        self.history: list[int] = []

    def digest(self, text: Column) -> Column:
        full = F.unhex(F.sha2(text, 256))
        return full if self.bits == 256 else F.substring(full, 1, self.bits // 8)

    def _write(self, rows: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        rows.sortWithinPartitions("run", "digest").write.option("parquet.bloom.filter.enabled#digest", "true").option("parquet.bloom.filter.expected.ndv#digest", str(FILTER_DIGESTS)).parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def flush(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """Add a batch of rows; returns its runs: id, size (code points of the original), digest, run."""
        rows = docs.select(
            F.col(doc_id).alias("id"), F.length(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("size"), self.digest(normalised(F.col(text))).alias("digest"), (F.spark_partition_id() + self.runs).cast("long").alias("run")
        )
        table = self._write(rows, f"level-0-{self.flushed}")
        self.flushed += 1
        self.runs = max(self.runs, (table.agg(F.max("run")).first()[0] or 0) + 1)
        self.tables.append(table)
        return table

    def _entries(self) -> DataFrame:
        """run, digest, best (the smallest is what stays), rows, of all tables."""
        found = []
        for t in self.tables:
            merged = "rows" in t.columns
            size, name = ("keep_size", "keep_id") if merged else ("size", "id")
            best = F.struct((-F.col(size)).alias("o"), F.col(name).alias("k"))
            found.append(t.select("run", "digest", best.alias("best"), F.col("rows") if merged else F.lit(1).cast("long").alias("rows")))
        return reduce(DataFrame.unionByName, found)

    def compact(self) -> DataFrame:
        """Merge level after level until one run is left: digest, keep_id, keep_size, rows."""
        self.history = [self.runs]
        while True:
            one = self._entries().groupBy(F.floor(F.col("run") / self.fanout).alias("run"), "digest").agg(F.min("best").alias("best"), F.sum("rows").alias("rows"))
            table = self._write(one.select("run", "digest", F.col("best.k").alias("keep_id"), (-F.col("best.o")).alias("keep_size"), "rows"), f"level-{len(self.history)}-{self.flushed}")
            drop_tables(*[t for t in self.tables if "rows" in t.columns])  # flushed rows belong to who flushed them
            self.tables = [table]
            self.runs = -(-self.runs // self.fanout)
            self.history.append(self.runs)
            if self.runs <= 1:
                self.runs = 1
                return table.drop("run")

    def probe(self, digests: list[bytes]) -> DataFrame:
        """Entries of given digests in all runs; the runs' filters and sorted pages skip the rest."""
        some = [bytearray(d) for d in digests]
        return reduce(DataFrame.unionByName, [t.filter(F.col("digest").isin(some)).select("run", "digest", F.col("keep_id" if "rows" in t.columns else "id").alias("keep_id")) for t in self.tables])


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = 256, fanout: int = FANOUT) -> DataFrame:
    """One row per row: its id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    spark = docs.sparkSession
    index = MergeIndex(spark, bits=bits, fanout=fanout)
    runs = index.flush(docs, doc_id, text)
    merged = index.compact()
    total = runs.count()
    hits = written(merged.filter(F.col("rows") > 1).select("digest", "keep_id", "rows"), "dedup-hits")
    bitmap, size = _bitmap(hits)
    classes = written(_verified(docs, index, bitmap, size, text, doc_id), "dedup-classes")
    collided = classes.groupBy("digest").count().filter("count > 1")
    drop_tables(merged)
    if bits == 256 and collided.isEmpty():
        # rows that the bitmap of hits doesn't know are alone and stay where they are; the others look their digest up
        alone = _asked(runs, bitmap, size).filter("not _maybe").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "digest")
        found = lookup(_asked(runs, bitmap, size).filter("_maybe").select("id", "digest"), hits.withColumnRenamed("keep_id", "best"), "digest", "rows", total)
        found = found.select("id", F.when(F.col("rows").isNull(), F.col("id")).otherwise(F.col("best")).alias("keep_id"), F.coalesce("rows", F.lit(1)).cast("long").alias("group_size"), "digest")
        out = alone.unionByName(found).withColumn("text_sha256", F.lower(F.hex("digest")))
    else:
        # different texts with one digest: their rows are told apart by the texts themselves
        whole = docs.select(F.col(doc_id).alias("id"), normalised(F.col(text)).alias("norm"))
        whole = whole.withColumn("digest", index.digest(F.col("norm")))
        given = classes.select("digest", "norm_key", F.col("keep_id").alias("best"), "rows")
        joined = whole.withColumn("norm_key", F.sha2("norm", 512)).join(given, ["digest", "norm_key"], "left")
        out = joined.select("id", F.when(F.col("rows").isNull(), F.col("id")).otherwise(F.col("best")).alias("keep_id"), F.coalesce("rows", F.lit(1)).cast("long").alias("group_size"), F.sha2("norm", 256).alias("text_sha256"))
    return out.select(F.col("id").alias(doc_id), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def _bit(bits: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(bits)) + 1


def _bitmap(hits: DataFrame) -> tuple[DataFrame, int]:
    """The bitmap of the hits' digests in pieces of 2 ** 15 bits, and how many bits there are."""
    bits = min(MOST_BITS, 1 << max(15, (hits.count() * HIT_BITS - 1).bit_length()))
    return written(hits.select(_bit(bits).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("_bitmap")), "dedup-bitmap"), bits


def _asked(rows: DataFrame, bitmap: DataFrame, bits: int) -> DataFrame:
    """Add _maybe, false if a row's digest is no hit; the bitmap (16 MB at most) is sent to all tasks."""
    place = F.bitmap_bit_position(_bit(bits)).cast("int")
    byte = F.conv(F.hex(F.substring("_bitmap", F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    joined = rows.join(F.broadcast(bitmap), F.bitmap_bucket_number(_bit(bits)) == F.col("_bucket"), "left")
    there = F.call_function("shiftright", byte, place % 8).bitwiseAND(F.lit(1)) == 1
    return joined.select(*rows.columns, F.coalesce(there, F.lit(False)).alias("_maybe"))


def _verified(docs: DataFrame, index: MergeIndex, bitmap: DataFrame, bits: int, text: str, doc_id: str) -> DataFrame:
    """Groups of equal texts among the rows that the bitmap knows: digest, norm_key, keep_id, rows.

    Copies in one task become one row before they are sent, so that a text with very many copies is a row for each task.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.length(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("size"), normalised(F.col(text)).alias("norm"))
    rows = _asked(rows.withColumn("digest", index.digest(F.col("norm"))), bitmap, bits).filter("_maybe")
    one = rows.groupBy("digest", "norm").agg(F.min(F.struct((-F.col("size")).alias("o"), F.col("id").alias("k"))).alias("best"), F.count(F.lit(1)).alias("rows"))
    return one.select("digest", F.sha2("norm", 512).alias("norm_key"), F.col("best.k").alias("keep_id"), "rows")
