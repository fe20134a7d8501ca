"""The prefix tree of conversations, from the smallest member of each prefix.

Each prefix of a conversation has a digest: the sum of hashes of its turns and their depths, a running sum over the sorted
table. A prefix is a node; it is owned by the smallest of the conversations that begin with it. Who owns a prefix owns all
its longer ones, so each conversation finds the first depth that it owns by binary search, all of them at a time: a round
looks up one prefix of each in the table of digests and their owners, and halves what is left. From its first owned depth
on, a conversation is a chain of nodes, which hangs from the last prefix that it doesn't own.

Chains are summed bottom-up by doubling: after k rounds a chain holds the sums of its descendants that are fewer than
2 ** k chains away, so that a tree of height h takes log h rounds. Sums of a node are those of its chain from its depth on.

No step gathers a conversation, the members of a node or the chains below one: sums run over sorted parts and groups are
added up before they are sent. The digest of a node's members is made of their sorted ids, put together by the thousand.

Definitions for odd input: turns of a conversation are ordered by turn (null first), then role, then text, so rows that
repeat a turn follow each other, and equal rows are turns of their own; a null role or text counts as empty; rows without a
conversation belong to none; a conversation without turns is a member of the root alone; texts of any length are read
whole; an empty table gives an empty result; other columns are not read, so their names may clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.scan import MASK, running
from kindred.llm.shared import drop_tables, lookup, map_arrow, written


def ordered(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Each turn as (conv, pos, digest, chars): its place from 1 on, the SHA-256 of role and text, the text's code points."""
    rows = messages.select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    made = {"pos": F.lit(1).cast("long"), "digest": digest, "chars": F.length("text").cast("long")}
    return running(rows.filter("conv is not null"), "conv", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], made, ["pos"], "turns")


def as_given(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are: (conv, depth, digest, chars) and (conv, len)."""
    return turns.withColumnRenamed("pos", "depth"), turns.groupBy("conv").agg(F.max("pos").alias("len"))


def rebuilt(turns: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of another, as (conv, depth, digest, chars) and (conv, len).

    Conversation c gets the first h turns of c - c % every (all if there are fewer), then its own after its first h, with
    h = crc32(c as text) % most. At most most - 1 turns of one conversation go to fewer than 2 * every others.
    """
    head = lambda c: F.crc32(F.col(c).cast("string")) % most
    own = written(turns.groupBy("conv").agg(F.max("pos").alias("own")), "lengths")
    donors = own.select(F.col("conv").alias("donor"), F.col("own").alias("has"))
    given = own.withColumn("h", head("conv")).withColumn("donor", F.col("conv") - F.col("conv") % every).join(donors, "donor", "left")
    given = given.withColumn("got", F.least("h", F.coalesce("has", F.lit(0)))).withColumn("len", F.col("got") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    given = written(given.select("conv", "donor", "h", "got", "own", "len"), "rebuilt")
    rest = lookup(turns.filter(F.col("pos") > head("conv")), given.select("conv", "got", "h", "own"), "conv", "own", turns.count())
    rest = rest.select("conv", (F.col("pos") - F.col("h") + F.col("got")).alias("depth"), "digest", "chars")
    heads = turns.filter((F.col("conv") % every == 0) & (F.col("pos") < most)).withColumnRenamed("conv", "donor")
    first = heads.join(given, "donor").filter(F.col("pos") <= F.col("h")).select("conv", F.col("pos").alias("depth"), "digest", "chars")
    return rest.unionByName(first), given.select("conv", "len")


def prefixes(turns: DataFrame) -> DataFrame:
    """Each prefix as (conv, depth, node, chars); node: its digest of 124 bits and its depth; chars: of its last turn."""
    part = lambda k: F.xxhash64(F.lit(k), "depth", "digest").bitwiseAND(F.lit(MASK))
    made = {"depth": F.col("depth"), "a": part(1), "b": part(2), "chars": F.col("chars")}
    return running(turns, "conv", [F.col("depth")], made, ["a", "b"], "prefixes").select("conv", "depth", F.struct("depth", "a", "b").alias("node"), "chars")


def first_owned(found: DataFrame, minima: DataFrame, convs: DataFrame, total: int, root: int) -> DataFrame:
    """By binary search: conv, first (the first depth it owns; one more than its length if none), parent (who owns the
    prefix before), of conversations with turns. found: prefixes; minima: node, owner, members."""
    limits = convs.filter("len > 0").select("conv", F.lit(1).cast("long").alias("lo"), (F.col("len") + 1).alias("hi"), F.lit(root).cast("long").alias("parent"), F.col("len").alias("left"))
    middle = F.floor((F.col("lo") + F.col("hi")) / 2)
    rows = lookup(found.select("conv", "depth", "node"), limits, "conv", "left", total)
    done: list[DataFrame] = []
    held: list[DataFrame] = []
    while True:
        asked = rows.filter(F.col("depth") == middle).select("conv", "depth", "node", "lo", "hi", "parent")
        owned = F.col("owner") == F.col("conv")
        answers = lookup(asked, minima, "node", "members", total).select(
            "conv", F.when(owned, F.col("lo")).otherwise(F.col("depth") + 1).alias("lo"), F.when(owned, F.col("depth")).otherwise(F.col("hi")).alias("hi"), F.when(owned, F.col("parent")).otherwise(F.col("owner")).alias("parent")
        )
        state = written(answers.withColumn("left", F.col("hi") - F.col("lo")), "search")
        done.append(state.filter("lo = hi").select("conv", F.col("lo").alias("first"), "parent"))
        if state.filter("lo < hi").isEmpty():
            drop_tables(*held)
            return reduce(DataFrame.unionByName, done)
        narrowed = lookup(rows.select("conv", "depth", "node"), state.filter("lo < hi"), "conv", "left", total)
        rows = written(narrowed.filter("depth >= lo and depth < hi"), "searched")
        drop_tables(*held)
        held = [rows]


def _descendants(chains: DataFrame, total: int) -> DataFrame:
    """Chains (conv, above, leaves, saved) with leaves and saved summed over themselves and all below them: conv, above, leaves, saved."""
    at, state, held = chains.select("conv", "above"), chains.withColumnRenamed("above", "next"), []
    while True:
        sums = state.filter("next is not null").groupBy(F.col("next").alias("up")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"), F.count(F.lit(1)).alias("n"))
        own = state.select(F.col("conv").alias("up"), F.col("next").alias("beyond"))
        table = written(sums.join(own, "up"), "chains-below")
        if table.isEmpty():
            return state.drop("next").join(at, "conv")
        moved = lookup(state.withColumnRenamed("next", "up"), table.select("up", "beyond", "n"), "up", "n", total).select("conv", F.col("beyond").alias("next"), "leaves", "saved")
        added = moved.join(table.select(F.col("up").alias("conv"), "more_leaves", "more_saved"), "conv", "left")
        plus = lambda c: (F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c)
        state = written(added.select("conv", "next", plus("leaves"), plus("saved")), "chain-sums")
        drop_tables(table, *held)
        held = [state]


def tree(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tree of conversations (see as_given): nodes and ends.

    nodes: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens.
    ends: conv_id and depth of the node where each conversation (member) ends.
    """
    found = prefixes(turns)
    convs = written(convs, "conversations")
    n_convs, root = convs.agg(F.count(F.lit(1)), F.coalesce(F.min("conv"), F.lit(0))).first()
    total = found.count() + n_convs
    minima = written(found.groupBy("node").agg(F.min("conv").alias("owner"), F.count(F.lit(1)).alias("members")), "prefix-minima")
    searched = first_owned(found, minima, convs, total, root)
    # the smallest conversation owns the root as well; those without turns own nothing
    is_root = F.col("conv") == F.lit(root)
    chains = convs.join(searched, "conv", "left").select(
        "conv", "len", F.when(is_root, F.lit(0)).otherwise(F.coalesce("first", F.lit(1))).cast("long").alias("first"), F.when(~is_root, F.coalesce("parent", F.lit(root))).alias("parent")
    )
    chains = written(chains, "chains")
    owning = chains.filter(F.col("first") <= F.col("len"))
    hung = owning.filter(F.col("parent").isNotNull())
    # nodes: owned prefixes with their members, and the root
    mine = lookup(found, owning.select("conv", "first", "len", "parent"), "conv", "len", total).filter(F.col("depth") >= F.col("first"))
    top = chains.filter(is_root).select("conv", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("chars"), "first", "len", "parent", F.lit(n_convs).cast("long").alias("members"))
    nodes = mine.join(minima.select("node", "members"), "node").select("conv", "depth", "chars", "first", "len", "parent", "members").unionByName(top)
    nodes = written(nodes, "owned")
    # chains with their own sums, then with all below them
    has = hung.groupBy(F.col("parent").alias("conv"), (F.col("first") - 1).alias("len")).agg(F.count(F.lit(1)).alias("below"))
    saved = nodes.groupBy("conv").agg(F.sum((F.col("members") - 1) * F.col("chars")).alias("saved"))
    leaf = F.when(F.col("below").isNull(), F.lit(1)).otherwise(F.lit(0)).cast("long").alias("leaves")
    own = owning.join(has, ["conv", "len"], "left").join(saved, "conv").select("conv", F.col("parent").alias("above"), leaf, "saved")
    sums = _descendants(written(own, "chain-sums"), total)
    at = hung.select("conv", F.col("parent").alias("at"), (F.col("first") - 1).alias("depth"))
    below = sums.drop("above").join(at, "conv").groupBy(F.col("at").alias("conv"), "depth").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"), F.count(F.lit(1)).alias("hung"))
    joined = nodes.join(below, ["conv", "depth"], "left")
    none = F.lit(0).cast("long")
    ends_here = F.col("depth") == F.col("len")
    made = {
        "depth": F.col("depth"),
        "parent_conv_id": F.when(F.col("depth") == F.col("first"), F.col("parent")).otherwise(F.col("conv")),
        "n_convs": F.col("members"),
        "n_children": F.coalesce("hung", none) + F.when(ends_here, none).otherwise(F.lit(1)),
        "n_leaves": F.coalesce("more_leaves", none) + F.when(ends_here & F.col("hung").isNull(), F.lit(1)).otherwise(none),
        "saved_tokens": F.coalesce("more_saved", none) + (F.col("members") - 1) * F.col("chars"),
    }
    summed = running(joined, "conv", [F.col("depth").desc()], made, ["n_leaves", "saved_tokens"], "nodes").withColumnRenamed("conv", "conv_id")
    member = chains.select(F.when(F.col("first") <= F.col("len"), F.col("conv")).otherwise(F.col("parent")).alias("conv_id"), F.col("len").alias("depth"), F.col("conv").alias("member"))
    return summed, member


def member_digests(ends: DataFrame, name: str) -> DataFrame:
    """conv_id, depth and the SHA-256 (lowercase hexadecimal) of the members' ids, ascending and joined by commas.

    Ids are put together where a global sort has dealt them; the digest itself can't be divided, so one task reads a
    node's pieces in order, each for thousands of members, and holds one at a time.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            conv, depth, member = (batch.column(i).to_numpy() for i in range(3))
            begins = np.flatnonzero(np.concatenate([[True], (np.diff(conv) != 0) | (np.diff(depth) != 0)]))
            words = list(map(str, member.tolist()))
            texts = [",".join(words[a:b]) for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(words)])]
            yield pa.RecordBatch.from_arrays([*(pa.array(x[begins]) for x in (conv, depth, member)), pa.array(texts)], names=["conv_id", "depth", "member", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            out: list[tuple[int, int, str]] = []
            for conv, depth, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if last == (conv, depth):
                    state.update(b",")
                else:
                    if state:
                        out.append((*last, state.hexdigest()))
                    last, state = (conv, depth), hashlib.sha256()
                state.update(ids.as_buffer())
            if out:
                yield _digests(out, name)
        if state:
            yield _digests([(*last, state.hexdigest())], name)

    key = ["conv_id", "depth"]
    dealt = ends.repartitionByRange(*key, "member").sortWithinPartitions(*key, "member").select(*key, "member")
    pieces = map_arrow(dealt, join, "conv_id long, depth long, member long, ids string")
    return map_arrow(pieces.repartition(*key).sortWithinPartitions(*key, "member").select(*key, "ids"), digest, f"conv_id long, depth long, `{name}` string")


def _digests(rows: list[tuple[int, int, str]], name: str) -> pa.RecordBatch:
    conv, depth, digest = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(depth, pa.int64()), pa.array(digest)], names=["conv_id", "depth", name])


def with_ends(nodes: DataFrame, ends: DataFrame, name: str = "ends_sha256") -> DataFrame:
    """Add the digest of the members that end at each node (of no id: that of the empty string)."""
    none: Column = F.lit(hashlib.sha256(b"").hexdigest())
    joined = nodes.join(member_digests(ends, name), ["conv_id", "depth"], "left")
    return joined.withColumn(name, F.coalesce(name, none))
