"""CSV files with quoted line breaks, read in parallel.

A file is cut into splits of lines by Spark's text source. Whether a split begins inside quotes depends on all before it, so
each split is first run through from both states; that gives a row for each split, and a pass over those rows tells in which
state, and in which record, each one begins. A second pass puts the lines of records together: a record of one line stays
where it is, and only lines of records that have several meet.

Quotes are `"`, doubled inside quotes, and only count at the begin of a field. Lines end with a line feed, or a carriage
return and a line feed. The first record of each file is its header; empty lines are no records.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Encodings in which a byte of a separator, quote or line feed is that character (fixed values).
BYTEWISE = ("utf-8", "utf8", "ascii", "us-ascii", "iso-8859-1", "latin-1", "latin1", "windows-1252", "cp1252")


def state_after(line: bytes, inside: bool, sep: bytes = b",") -> bool:
    """True if a line ends inside quotes; inside: it begins so."""
    at = 0
    while True:
        if not inside:
            if line[at : at + 1] == b'"':
                inside, at = True, at + 1
                continue
        else:
            at = line.find(b'"', at)
            while at >= 0 and line[at + 1 : at + 2] == b'"':
                at = line.find(b'"', at + 2)
            if at < 0:
                return True
            inside = False
        at = line.find(sep, at)
        if at < 0:
            return False
        at += len(sep)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[bytes]]]:
    """Runs of lines of one split; a split's lines come in order, in one task."""
    for batch in batches:
        files, starts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        at = 0
        while at < len(batch):
            stop = at
            while stop < len(batch) and (files[stop], starts[stop]) == (files[at], starts[at]):
                stop += 1
            yield files[at], starts[at], (x.as_py() for x in batch.column(2).slice(at, stop - at))
            at = stop


def _summaries(lines: DataFrame, sep: bytes) -> dict[tuple[str, int], tuple[bool, tuple[int, int]]]:
    """For each split: does it begin inside quotes, and the record that is open there, as (start of its split, line)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list] = {}
        for file, start, some in _splits(batches):
            # of either state at the split's begin: the state now, and the line where the last record began
            own = found.setdefault((file, start), [0, [False, True], [-1, -1]])
            for line in some:
                for k in (0, 1):
                    if not own[1][k]:
                        own[2][k] = own[0]
                quoted = b'"' in line
                if quoted:
                    own[1] = [state_after(line, s, sep) for s in own[1]]
                own[0] += 1
        if found:
            rows = [(file, start, n, *states, *last) for (file, start), (n, states, last) in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["file", "start", "n", "state0", "state1", "last0", "last1"])

    rows = lines.mapInArrow(work, "file string, start long, n long, state0 boolean, state1 boolean, last0 long, last1 long").collect()  # a row a split
    out: dict[tuple[str, int], tuple[bool, tuple[int, int]]] = {}
    file, state, open_ = None, False, (0, 0)
    for r in sorted(rows, key=lambda r: (r["file"], r["start"])):
        if r["file"] != file:
            file, state, open_ = r["file"], False, (0, 0)
        out[file, r["start"]] = (state, open_)
        last = r["last1"] if state else r["last0"]
        open_ = (r["start"], last) if last >= 0 else open_
        state = r["state1"] if state else r["state0"]
    return out


def records(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(file, start, line, record): each record's bytes without its last line break, and where it begins: the split and the line in it."""
    lines, cut = _lines(spark, path), sep.encode()
    begins = spark.sparkContext.broadcast(_summaries(lines, cut))  # an entry a split

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple[str, int], list] = {}
        for file, start, some in _splits(batches):
            # the line's number, the state, the open record
            own = states.setdefault((file, start), [0, *begins.value[file, start]])
            numbers, keys, texts, fresh = [], [], [], []
            for line in some:
                fresh.append(not own[1])
                if not own[1]:
                    own[2] = (start, own[0])
                if b'"' in line:
                    own[1] = state_after(line, own[1], cut)
                numbers.append(own[0])
                keys.append(own[2])
                texts.append(line)
                own[0] += 1
            # a record of one line begins there, and the next line begins another; of the last line that isn't known if quotes are open
            alone = [a and b for a, b in zip(fresh, [*fresh[1:], not own[1]])]
            n = len(texts)
            key_start, key_line = zip(*keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array([file] * n), pa.array(key_start, pa.int64()), pa.array(key_line, pa.int64()), pa.array([start] * n, pa.int64()), pa.array(numbers, pa.int64()), pa.array(alone), pa.array(texts, pa.binary())],
                names=["file", "start", "line", "split", "number", "alone", "record"],
            )

    found = lines.mapInArrow(work, "file string, start long, line long, split long, number long, alone boolean, record binary")
    key = ["file", "start", "line"]
    parts = found.filter("not alone").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("split", "number", "record"))).alias("parts"))
    join = F.aggregate(F.slice("parts", F.lit(2), F.size("parts")), F.element_at("parts", 1)["record"], lambda a, x: F.concat(a, F.lit(b"\n"), x["record"]))
    return found.filter("alone").select(*key, "record").unionByName(parts.select(*key, join.alias("record")))


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8", sep: str = ",", place: str | None = None) -> DataFrame:
    """All records of CSV files with a header, all columns as strings, in as many tasks as the files have splits.

    place: the name of a further column that is ordered as the records are in their files.
    """
    options = {"sep": sep, "escape": '"', "encoding": encoding}
    whole = spark.read.options(header=True, inferSchema=False, multiLine=True, **options).csv(path)  # for the header alone
    names = whole.columns
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    found = records(spark, path, sep).filter((F.col("start") > 0) | (F.col("line") > 0))
    text = F.col("record").cast("string") if encoding.lower() in ("utf-8", "utf8") else F.decode("record", encoding)
    text = F.regexp_replace(text, "\r\\z", "")
    kept = [F.struct("file", "start", "line").alias(place)] if place else []
    parsed = found.select(text.alias("text"), *kept).filter("text <> ''").select(F.from_csv("text", schema, {"sep": sep, "escape": '"', "multiLine": "true"}).alias("r"), *([place] if place else []))
    return parsed.select(*[F.col(f"r.c{i}").alias(n.lstrip("\ufeff")) for i, n in enumerate(names)], *([place] if place else []))
