"""Synthetic worlds of duplicate records: entities by hash-seeded columns, assignments, hard negatives, observation.

Results depend on the seed alone, not on partitions: every draw is a hash of a row's own key.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.plans.worldgraph import CONTRACTS, NODES, RULES, Contract, Rule, ancestors, choose_rules, descendants, draw, eligible_contracts, sample_fields, topological_order
from kindred.storage import written


def sample_entity_ids(n: int, p_match: float, seed: int) -> np.ndarray:
    """Entities of n records by the Chinese restaurant process; two records match with probability p_match."""
    if not 0 < p_match <= 1:
        raise ValueError("p_match must be over 0 and at most 1")
    g, alpha = np.random.default_rng(seed), (1 - p_match) / p_match
    ids = np.zeros(n, np.int64)
    known = 0
    for i in range(n):
        # taking an earlier record's entity at random takes an entity by its size
        ids[i] = ids[g.integers(i)] if i and g.random() < i / (i + alpha) else known
        known = max(known, ids[i] + 1)
    return ids


def assignments(worlds: DataFrame, p_match: float) -> DataFrame:
    """world_id, record, entity for worlds (world_id, seed, n_records); worlds run in parallel, each in one task."""

    def one(table: pd.DataFrame) -> pd.DataFrame:
        row = table.iloc[0]
        ids = sample_entity_ids(int(row["n_records"]), p_match, int(row["seed"]))
        return pd.DataFrame({"world_id": row["world_id"], "record": np.arange(len(ids)), "entity": ids})

    return worlds.groupBy("world_id").applyInPandas(one, "world_id long, record long, entity long")


def entities(spark: SparkSession, n: int, nodes: list[str], seed: int, rules: dict[str, Rule] | None = None) -> DataFrame:
    """entity and a column per node (and what they depend on) for n entities."""
    active = ancestors(nodes)
    rules = rules or choose_rules(active, seed)
    df = spark.range(n).select(F.col("id").alias("entity"), F.xxhash64("id", F.lit(seed)).alias("_seed"))
    for node in topological_order(active):
        df = df.withColumn(node, rules[node].make("_seed"))
    return df


#: Entities among which a near-miss finds its base.
GROUP = 16


def add_hard_negatives(df: DataFrame, rate: float, seed: int, rules: dict[str, Rule], contracts: tuple[Contract, ...] = CONTRACTS) -> DataFrame:
    """Turn a share of entities into near-misses of others: adds base (an entity, or null) and contract.

    Every entity is a target by a draw; its base is one of the GROUP consecutive ids it is in that is none (if all were
    drawn, the last drawn is none). Preserved columns come from the base; rerolled ones and what depends on them are made
    from the target's own seed.
    """
    if not 0 <= rate <= 1:
        raise ValueError("rate must be from 0 to 1")
    nodes = [n for n in NODES if n in df.columns]
    kinds = eligible_contracts(nodes, contracts)
    if not kinds:
        return df.withColumn("base", F.lit(None).cast("long")).withColumn("contract", F.lit(None).cast("string"))
    edges = np.cumsum([c.weight for c in kinds]) / sum(c.weight for c in kinds)
    marked = df.withColumn("_h", F.xxhash64("entity", F.lit(seed), F.lit("hard"))).withColumn("_group", F.floor(F.col("entity") / GROUP)).withColumn("_u", draw("_h", "target"))
    free = marked.groupBy("_group").agg(F.array_sort(F.collect_list(F.when(F.col("_u") >= rate, F.col("entity")))).alias("_free"), F.max_by("entity", F.struct("_u", "entity")).alias("_last"))
    free = free.select("_group", F.when(F.size("_free") > 0, F.col("_free")).otherwise(F.array("_last")).alias("_free"))
    contract = F.lit(None).cast("string")
    for c, edge in reversed(list(zip(kinds, edges))):
        contract = F.when(draw("_h", "kind") <= float(edge), F.lit(c.name)).otherwise(contract)
    target = ~F.array_contains("_free", F.col("entity"))
    chosen = F.element_at("_free", F.floor(draw("_h", "base") * F.size("_free")).cast("int") + 1)
    marked = marked.join(free, "_group").withColumn("base", F.when(target, chosen)).withColumn("contract", F.when(target, contract))
    bases = df.select(F.col("entity").alias("base"), *[F.col(n).alias(f"_base_{n}") for n in nodes])
    out = marked.join(bases, "base", "left")
    for node in topological_order(nodes):
        value = F.col(node)
        for c in kinds:
            kept = node in c.preserve or node not in c.reroll and node not in descendants(c.reroll, c.preserve)
            if kept:
                value = F.when(F.col("contract") == c.name, F.col(f"_base_{node}")).otherwise(value)
            elif rules[node].inputs:  # its inputs may have been taken from the base by now
                value = F.when(F.col("contract") == c.name, rules[node].make("_seed")).otherwise(value)
        out = out.withColumn(node, value)
    return out.select(*df.columns, "base", "contract")


# -- observation -------------------------------------------------------------------------------------------------

#: Characters that look alike, and neighbours on a keyboard.
_OCR = ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "o6ecft9bljkinmocgns7vuvxg2R8GOF7CNlJXIHMQFOPS7VUVXV2OlZBASbTBg")
_KEYS = ("qwertyuiopasdfghjklzxcvbnmQWERTYUIOPASDFGHJKLZXCVBNM0123456789", "wqwertyuiosasdfghjkxzxcvbnWQWERTYUIOSASDFGHJKXZXCVBN9012345678")


#: First names and what some people are called instead.
NICKNAMES = (("Alice", "Allie"), ("Benjamin", "Ben"), ("Daniel", "Dan"), ("Grace", "Gracie"), ("Jack", "Jackie"), ("Jane", "Janie"), ("Julia", "Jules"), ("Maria", "Mia"), ("Samuel", "Sam"), ("Sara", "Sally"), ("Sofia", "Sophie"), ("Victor", "Vic"))


@dataclass(frozen=True)
class Observation:
    missing_rate: float = 0.05
    nickname_rate: float = 0.1
    corruption_rate: float = 0.1


def corrupt(value: Column, seed: str, salt: str) -> Column:
    """One of six changes at a random place: look-alike, key next to it, insertion, substitution, swap, deletion.

    A character that has no look-alike or neighbour is substituted; the last one is swapped with the one before it.
    """
    n = F.length(value)
    at = F.floor(draw(seed, salt + "at") * F.greatest(n, F.lit(1))).cast("int") + 1
    head, here, tail = F.substring(value, F.lit(1), at - 1), F.substring(value, at, F.lit(1)), F.substring(value, at + 1, n)
    letter = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), F.floor(draw(seed, salt + "letter") * 26).cast("int") + 1, F.lit(1))
    other = F.when(F.lower(here) == letter, F.lit("-")).otherwise(letter)
    like = lambda table: F.when(F.translate(here, *table) != here, F.translate(here, *table)).otherwise(other)
    left = F.least(at, F.greatest(n - 1, F.lit(1)))
    kinds = [
        F.concat(head, like(_OCR), tail),
        F.concat(head, like(_KEYS), tail),
        F.concat(head, letter, here, tail),
        F.concat(head, other, tail),
        F.concat(F.substring(value, F.lit(1), left - 1), F.substring(value, left + 1, F.lit(1)), F.substring(value, left, F.lit(1)), F.substring(value, left + 2, n)),
        F.concat(head, tail),
    ]
    return F.when(n >= 2, F.element_at(F.array(*kinds), F.floor(draw(seed, salt + "kind") * 6).cast("int") + 1)).otherwise(value)


def observe(df: DataFrame, key: list[str], field_types: dict[str, str], config: Observation = Observation(), seed: int = 0, nicknames: DataFrame | None = None) -> DataFrame:
    """Values as a source may have them: missing, a nickname for a first name, or (texts and identifiers) corrupted."""
    out = df.withColumn("_o", F.xxhash64(*key, F.lit(seed)))
    if nicknames is not None and "first_name" in field_types:
        out = out.join(nicknames.withColumnRenamed("name", "_nick"), F.lower("first_name") == F.col("_nick"), "left").drop("_nick")
        i = F.floor(draw("_o", "nick") * F.size("aliases")).cast("int") + 1
        use = F.col("aliases").isNotNull() & (draw("_o", "nickname") < config.nickname_rate)
        out = out.withColumn("first_name", F.when(use, F.initcap(F.element_at("aliases", i))).otherwise(F.col("first_name"))).drop("aliases")
    for c, kind in field_types.items():
        value = F.col(c)
        if kind in ("text", "identifier"):
            value = F.when(draw("_o", c + "corrupt") < config.corruption_rate, corrupt(value, "_o", c)).otherwise(value)
        out = out.withColumn(c, F.when(draw("_o", c + "missing") >= config.missing_rate, value))
    return out.drop("_o")


@dataclass(frozen=True)
class World:
    records: DataFrame
    field_types: dict[str, str]
    rules: dict[str, Rule]


def generate_world(spark: SparkSession, n_records: int = 100, n_fields: int = 6, seed: int = 0, p_match: float = 0.02, hard_negative_rate: float = 0.0, observation: Observation = Observation(), fields: list[str] | None = None, nicknames: DataFrame | None = None, assigned: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> World:
    """A world of records (record_id, entity_id, fields). assigned: (record, entity), if not drawn here."""
    fields = fields or sample_fields(n_fields, seed)
    if assigned is None:
        one = spark.createDataFrame([(0, seed, n_records)], "world_id long, seed long, n_records long")
        assigned = written(assignments(one, p_match), "assignments").select("record", "entity")
    n_entities = assigned.agg(F.coalesce(F.max("entity") + 1, F.lit(0))).first()[0]
    rules = choose_rules(ancestors(fields), seed, rules)
    people = entities(spark, n_entities, fields, seed, rules)
    if hard_negative_rate:
        people = add_hard_negatives(people, hard_negative_rate, seed, rules)
    types = {f: NODES[f] for f in fields}
    records = assigned.join(people, "entity").select(F.col("record").alias("record_id"), F.col("entity").alias("entity_id"), *fields)
    return World(observe(records, ["record_id"], types, observation, seed, nicknames), types, rules)


def generate_worlds(spark: SparkSession, n_worlds: int, seed: int = 0, records: tuple[int, int] = (50, 300), fields: tuple[int, int] = (3, 10), p_match: float = 0.02) -> list[World]:
    """Worlds with sizes drawn from ranges. Each is a plan of its own, as it has its own columns; who is who is drawn for all at once, in parallel."""
    drawn = []
    for i in range(n_worlds):
        g = np.random.default_rng((seed, i))
        drawn.append((i, int(g.integers(1 << 31)), int(g.integers(records[0], records[1] + 1)), int(g.integers(fields[0], fields[1] + 1))))
    worlds = spark.createDataFrame([w[:3] for w in drawn], "world_id long, seed long, n_records long")
    assigned = written(assignments(worlds.repartition("world_id"), p_match), "assignments")
    return [generate_world(spark, n, k, own, p_match, assigned=assigned.filter(F.col("world_id") == i).select("record", "entity")) for i, own, n, k in drawn]
