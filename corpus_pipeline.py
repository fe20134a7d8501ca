"""A corpus pipeline of five operators; each stage reads what its predecessor wrote.

Rows are told apart by where they are stored, not by their ids: each is judged on its own text, and decisions take effect
row by row, also where ids are missing or shared.

Definitions for odd input: a null text counts as empty; empty texts are copies of each other; equal rows are copies, of
which one stays; of copies the one with the most code points stays, and of those, as of near copies, the one with the
smallest id, then the first in storage; a missing id comes before all others; texts of any length are read whole; an
empty table gives an empty one; columns besides those of documents pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import decontaminate, exactdedup, packing, simhash, toxicity
from kindred.storage import written


def _free(docs: DataFrame, name: str) -> str:
    """A name for a column that the documents don't have; Spark doesn't tell upper from lower case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """Add a key to each row: its id, its file and its place there. Files don't change, so neither do keys when a task is run again."""
    try:
        place, key = docs.metadataColumn("_metadata"), _free(docs, "_row_key")
        return docs.withColumn(key, F.struct(F.col("doc_id"), place["file_path"], place["row_index"])), key
    except AnalysisException:  # not rows of files
        return _keyed(written(docs, "documents"))


def _without(docs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Keyed documents but those whose key is in gone, which is written first: its size is then known when the join is planned."""
    return docs.join(written(gone.select(key), "gone"), key, "left_anti").drop(key)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity classifier doesn't predict as toxic; learned from those of `labels` outside the held-out fold."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = _free(docs, "_toxic_score")
    return toxicity.with_score(docs, model, name=score).filter(F.col(score) < toxicity.THRESHOLD).drop(score)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for white space."""
    keyed, key = _keyed(docs)
    return _without(keyed, exactdedup.dedup(keyed, key).filter(~F.col("kept")), key)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest key of each SimHash component."""
    keyed, key = _keyed(docs)
    return _without(keyed, simhash.near_duplicates(keyed, key).filter(F.col(key) != F.col("component_id")), key)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which fewer than one word in twenty lies in a benchmark window."""
    match = _free(docs, "_match")
    found = decontaminate.with_match(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), match)
    return found.filter(~decontaminate.contaminated(F.col(match))).drop(match)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("decontamination", drop_contaminated), ("packing", pack_sequences)]

#: Tokenizing can't be expressed in SQL; tests compare the result with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
