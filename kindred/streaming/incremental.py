"""Incremental linkage: new records of a stream are scored against known ones and against each other, block by block.

This is an extension. Each micro-batch joins the known table, and itself, on a blocking key; matches at the threshold or
above are written to a folder of the batch's number, and so are its records, which become known for later batches. A batch
that is run again finds the folders of its number, replaces them and doesn't read them, so it gives the same links.
ComponentStore keeps the components of all links so far up to date, batch by batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kindred.operators.graph import merge_components
from kindred.operators.pairs import dealt_join
from kindred.storage import path_exists, written


def link_batch(batch: DataFrame, known: DataFrame, key: str, record_id: str, score: Callable[[], Column], threshold: float) -> DataFrame:
    """left_id, right_id, score of pairs that agree on the key; score is an expression over left_ and right_ columns.

    Known records are on the left of new ones; of two new ones the smaller id is. Rows of one id make no pair, a null key
    matches nothing, and keys of many rows are dealt over tasks.
    """

    def side(rows: DataFrame, prefix: str) -> DataFrame:
        return rows.filter(F.col(key).isNotNull()).select(F.col(key).alias("_key"), *[F.col(c).alias(f"{prefix}{c}") for c in rows.columns])

    left, right = F.col(f"left_{record_id}"), F.col(f"right_{record_id}")
    new = side(batch, "right_")
    across = dealt_join(side(known, "left_"), new, ["_key"], f"left_{record_id}").filter(left != right)
    within = dealt_join(side(batch, "left_"), new, ["_key"], f"left_{record_id}").filter(left < right)
    found = across.unionByName(within).select(left.alias("left_id"), right.alias("right_id"), score().alias("score"))
    return found.filter(F.col("score") >= threshold)


def known_records(spark: SparkSession, batch: DataFrame, folder: str, number: int) -> DataFrame:
    """The records of a folder with the batch's columns, but for what a batch of that number left there."""
    if not path_exists(spark, folder):
        return batch.limit(0)
    rows = spark.read.schema(batch.schema).option("recursiveFileLookup", "true").parquet(folder)
    return rows.filter(~F.col("_metadata.file_path").contains(f"/batch-{number}/"))


def start_linkage(stream: DataFrame, known_path: str, links_path: str, checkpoint: str, key: str, record_id: str, score: Callable[[], Column], threshold: float = 0.5, components: ComponentStore | None = None) -> StreamingQuery:
    """Run until the stream has nothing new; links go to links_path, and to the components if given."""

    def each(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        batch = batch.persist()
        links = link_batch(batch, known_records(spark, batch, known_path, number), key, record_id, score, threshold)
        links.write.mode("overwrite").parquet(f"{links_path}/batch={number}")
        if components is not None:
            components.add(spark.read.schema(links.schema).parquet(f"{links_path}/batch={number}"), number)
        batch.write.mode("overwrite").parquet(f"{known_path}/batch-{number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class ComponentStore:
    """Components (node, component_id) of links that come in batches, as one table for each batch in a folder.

    A batch is merged into the table of the one before it, so a batch that is run again starts from where it did before.
    Only components that new links touch are contracted; the table of the batch before the last is deleted.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, number: int) -> str:
        return f"{self.folder}/after-{number}"

    def _numbers(self) -> list[int]:
        if not path_exists(self.spark, self.folder):
            return []
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        names = [f.getPath().getName() for f in path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)]
        done = (n.removeprefix("after-") for n in names if n.startswith("after-") and path_exists(self.spark, f"{self.folder}/{n}/_SUCCESS"))
        return sorted(map(int, done))

    def read(self, number: int | None = None) -> DataFrame | None:
        """Components after a batch (the last one, if not given); None before the first."""
        numbers = self._numbers()
        number = (numbers[-1] if numbers else None) if number is None else number
        return None if number is None else self.spark.read.parquet(self._path(number))

    def add(self, links: DataFrame, number: int, left: str = "left_id", right: str = "right_id") -> DataFrame:
        earlier = [n for n in self._numbers() if n < number]
        before = self.read(earlier[-1]) if earlier else None
        merge_components(before, links, left, right).write.mode("overwrite").parquet(self._path(number))
        for n in earlier[:-1]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(n))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return self.read(number)


def merged_in_batches(links: DataFrame, batch: Column, batches: int, left: str = "left_id", right: str = "right_id") -> DataFrame:
    """Components (node, component_id) of links, merged batch by batch."""
    found = None
    for number in range(batches):
        found = written(merge_components(found, links.filter(batch == number), left, right), "merged")
    return found


def windowed_counts(stream: DataFrame, ts: str, key: str, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts per key in tumbling windows, with a watermark for late rows."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), key, "n")
