"""Chat formatting by quotation linking.

A line's quote level is the number of `>` signs that begin it (spaces between them are allowed). Lines of one level in
a row are a passage; blank lines cut it into paragraphs. Passages, paragraphs and lines are normalised (marks taken off,
white space collapsed, A-Z lower-cased) and hashed; a quoted passage of level n is looked for among the passages of level
n - 1 of earlier messages of its conversation, by hash and text. If there is none, its paragraphs are looked for among
such paragraphs, and the lines of those that aren't found among such lines. The latest such message is what it was quoted
from, and the message replies to the latest of those. Conversations are put in reply order: threads by their first message, messages of a thread by turn;
quoted lines are left out of the text.

Only DataFrame functions run. Quotes and sources of a passage meet in a running maximum by turn, never in pairs. Hashes
are part of every join and shuffle key, and the turns of one passage are cut into slots of SLOT, so that neither a
conversation nor a passage that is quoted all the time makes a task large: a slot starts with the latest source before it.
Places within a conversation come from a global sort and a prefix sum over its parts.

Definitions for odd input: a null text has no passages and becomes an empty one; a null conversation or turn links to
nothing, and its rows are threads of their own; rows that repeat a conversation and turn are messages of the same
place, each given back; of equal rows the place is any; blank passages link to nothing; without quotes every message
begins a thread; texts of any length are read whole; an empty table gives an empty result; other columns are not read,
so their names may clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.llm.shared import written

#: Turns that are looked through together, where turns are numbers.
SLOT = 1024

_MARKS = "^[ \\t]*((?:>[ \\t]*)+)"


def _levels(text: Column) -> Column:
    """The lines of a text as (level, line without marks)."""
    lines = F.split(F.coalesce(text.cast("string"), F.lit("")), "\\r\\n|\\r|\\n")
    return F.transform(lines, lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, _MARKS, 1), "[^>]", "")).alias("level"), F.regexp_replace(x, _MARKS, "").alias("line")))


def _plain(line: Column) -> Column:
    text = F.trim(F.regexp_replace(line, "[\\x20\\x09-\\x0D]+", " "))
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _cut(texts: Column, first: Column, last: Column) -> Column:
    """The slices of an array from each place in first to that in last."""
    return F.transform(first, lambda b, k: F.slice(texts, b, F.element_at(last, k + 1) - b + 1))


def pieces(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """One row per passage (kind 0), paragraph (1) and line (2): conv, turn, level, run and par (places of its passage and paragraph), kind, piece (normalised), hash."""
    lines = messages.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), _levels(F.col(text)).alias("lines"))
    # a passage begins where the level changes; its lines are those up to the next such place
    level = lambda i: F.element_at("lines", i)["level"]
    all_ = F.sequence(F.lit(1), F.size("lines"))
    begins = F.filter(all_, lambda i: (i == 1) | (level(i) != level(F.greatest(i - 1, F.lit(1)))))
    ends = F.filter(all_, lambda i: (i == F.size("lines")) | (level(i) != level(F.least(i + 1, F.size("lines")))))
    runs = lines.withColumn("begins", begins).withColumn("ends", ends).select("conv", "turn", F.posexplode(_cut(F.col("lines"), F.col("begins"), F.col("ends"))).alias("run", "own"))
    plain = runs.select("conv", "turn", "run", F.element_at("own", 1)["level"].alias("level"), F.transform("own", lambda x: _plain(x["line"])).alias("texts"))
    # a paragraph is a row of lines that aren't blank
    at = lambda i: F.element_at("texts", i)
    all_ = F.sequence(F.lit(1), F.size("texts"))
    first = F.filter(all_, lambda i: (at(i) != "") & ((i == 1) | (at(F.greatest(i - 1, F.lit(1))) == "")))
    last = F.filter(all_, lambda i: (at(i) != "") & ((i == F.size("texts")) | (at(F.least(i + 1, F.size("texts"))) == "")))
    joined = F.concat_ws(" ", F.filter("texts", lambda x: x != "")).alias("whole")
    parts = plain.withColumn("first", first).withColumn("last", last).select("conv", "turn", "level", "run", joined, F.posexplode(_cut(F.col("texts"), F.col("first"), F.col("last"))).alias("par", "own"))
    piece = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("piece"))
    whole = F.filter(F.array(piece(0, F.col("whole"))), lambda _: F.col("par") == 0)
    made = F.concat(whole, F.array(piece(1, F.array_join("own", " "))), F.transform(F.array_distinct("own"), lambda x: piece(2, x)))
    rows = parts.select("conv", "turn", "level", "run", "par", F.explode(made).alias("p")).select("conv", "turn", "level", "run", "par", "p.*")
    return rows.withColumn("hash", F.xxhash64("piece"))


def link(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """What each quoting message replies to: conv, turn, parent (a turn)."""
    found = pieces(messages, conv, turn, text).filter("conv is not null and turn is not null")
    key = ["conv", "level", "kind", "hash"]
    # quotes are written first: where there are few, their keys are sent to the sources, which then aren't shuffled
    quoted = written(found.filter("level > 0").withColumn("level", F.col("level") - 1), "quotes")
    sources = found.join(quoted.select(*key).distinct(), key, "left_semi").groupBy(*key, "piece", "turn").agg(F.lit(None).cast("int").alias("run"), F.lit(None).cast("int").alias("par"))
    slot = F.floor(F.col("turn") / SLOT).cast("long") if isinstance(messages.schema[turn].dataType, T.NumericType) else F.lit(0).cast("long")
    both = written(quoted.withColumn("source", F.lit(False)).unionByName(sources.withColumn("source", F.lit(True))).withColumn("slot", slot), "quotes-and-sources")
    key = [*key, "piece"]
    # the latest source before each slot goes into the slot
    last = both.groupBy(*key, "slot").agg(F.max(F.when(F.col("source"), F.col("turn"))).alias("last"))
    earlier = Window.partitionBy(*key).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.withColumn("turn", F.max("last").over(earlier)).filter("turn is not null").withColumn("source", F.lit(True)).drop("last")
    rows = both.unionByName(carried, allowMissingColumns=True)
    # the latest source before each quote, by a running maximum over both; at equal turns, quotes come first
    before = Window.partitionBy(*key, "slot").orderBy("turn", "source").rowsBetween(Window.unboundedPreceding, -1)
    met = rows.withColumn("parent", F.max(F.when(F.col("source"), F.col("turn"))).over(before)).filter("not source and parent is not null")
    # what is found whole isn't looked for by its parts
    best = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("parent")))
    by_par = met.groupBy("conv", "turn", "run", "par").agg(best(0).alias("whole"), F.coalesce(best(1), best(2)).alias("part"))
    by_run = by_par.groupBy("conv", "turn", "run").agg(F.coalesce(F.max("whole"), F.max("part")).alias("parent"))
    return by_run.groupBy("conv", "turn").agg(F.max("parent").alias("parent"))


def roots(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """The first message and the depth of each message that replies: conv, turn, root, depth; by pointer doubling."""
    state = written(links.select("conv", "turn", F.col("parent").alias("root"), F.lit(1).alias("depth")), "reply-links")
    for _ in range(max_rounds):
        above = state.select("conv", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        joined = state.join(above, ["conv", "root"], "left")
        if joined.filter("next is not null").isEmpty():
            return state
        state = written(joined.select("conv", "turn", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "reply-links")
    raise RuntimeError("replies did not end")


def unquoted(text: Column) -> Column:
    """A text's lines of level 0, without blank lines at its begin and end."""
    kept = F.transform(F.filter(_levels(text), lambda x: x["level"] == 0), lambda x: x["line"])
    return F.regexp_replace(F.array_join(kept, "\n"), "^\\s+|\\s+$", "")


def conversations(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message: conv, turn, role, parent_turn, thread_turn, depth, place (from 0, in reply order), text (without quotes)."""
    replies = written(link(messages, conv, turn, text), "replies")
    found = roots(replies).join(replies, ["conv", "turn"])
    rows = messages.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), unquoted(F.col(text)).alias("text"))
    joined = rows.join(found, ["conv", "turn"], "left").select("conv", "turn", "role", F.col("parent").alias("parent_turn"), F.coalesce("root", "turn").alias("thread_turn"), F.coalesce("depth", F.lit(0)).alias("depth"), "text")
    # places: a global sort, then each part of a conversation learns how many of its rows are in earlier parts
    dealt = joined.repartitionByRange("conv", "thread_turn", "turn", "role", "text").sortWithinPartitions("conv", "thread_turn", "turn", "role", "text")
    ordered = written(dealt.withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()), "reply-order")
    parts = ordered.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(F.col("conv").alias("_conv"), F.col("part").alias("_part"), "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = ordered.join(starts, ordered["conv"].eqNullSafe(F.col("_conv")) & (ordered["part"] == F.col("_part")))
    out = placed.select("conv", "turn", "role", "parent_turn", "thread_turn", "depth", (F.col("before") + F.col("row") - F.col("first")).alias("place"), "text")
    return out.withColumnRenamed("conv", conv).withColumnRenamed("turn", turn).withColumnRenamed("role", role).withColumnRenamed("text", text)
