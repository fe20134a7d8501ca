"""Closures and layers of an edge table (parent, child) by rounds; a round reads what the last one reached, and edges.

Rounds are written to the shared folder, so lineage stays short; their number is the length of the longest path. Edges with a
null end, and repeated ones, count as none. A closure's rounds are joined by shuffles: broadcasts of what each round reached would
go through the driver, and in sum grow with the table and the rounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.storage import drop_tables, written


def _edges(edges: DataFrame, parent: str, child: str) -> DataFrame:
    return written(edges.select(F.col(parent).alias("parent"), F.col(child).alias("child")).filter("parent is not null and child is not null").distinct(), "edges")


def closure(edges: DataFrame, starts: DataFrame, start: str = "node", parent: str = "parent", child: str = "child", up: bool = False, blocked: DataFrame | None = None, max_rounds: int = 10_000) -> DataFrame:
    """(start, node, distance) of all that can be reached from each start, along edges or (up) against them; the start itself
    only if it is on a cycle. blocked: nodes (column node) that are neither reached nor passed through."""
    e = _edges(edges, parent, child)
    step = e.select(F.col("child").alias("at"), F.col("parent").alias("to")) if up else e.select(F.col("parent").alias("at"), F.col("child").alias("to"))
    if blocked is not None:
        step = step.join(blocked.select(F.col("node").alias("to")).hint("merge"), "to", "left_anti")
    step = written(step, "steps")
    reached = written(starts.select(F.col(start).alias("start")).filter("start is not null").distinct().select("start", F.col("start").alias("node"), F.lit(0).alias("distance")), "reached")
    front, parts = reached, []
    for number in range(1, max_rounds + 1):
        new = front.hint("merge").join(step.hint("merge"), front["node"] == step["at"]).select("start", F.col("to").alias("node")).distinct()
        if parts:
            new = new.join(_union(parts).hint("merge"), ["start", "node"], "left_anti")
        front = written(new.withColumn("distance", F.lit(number)), "reached")
        if front.isEmpty():
            break
        parts.append(front)
        if len(parts) > 8:  # few tables to look in: they are put together, eight times less often than there are rounds
            parts = [written(_union(parts), "reached")]
    else:
        raise RuntimeError(f"the closure isn't complete after {max_rounds} rounds")
    found = _union(parts) if parts else front
    drop_tables(e)
    return found.select("start", "node", "distance")


def _union(tables: Sequence[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def descendants(edges: DataFrame, starts: DataFrame, start: str = "node", parent: str = "parent", child: str = "child", blocked: DataFrame | None = None) -> DataFrame:
    """(node): all that depends on some start, not passing through blocked nodes, without the starts."""
    one = starts.select(F.col(start).alias("node")).distinct()
    # from one common place, so that what several starts reach is looked at once
    place = F.lit(0)
    entry = edges.select(F.col(parent).alias("node"), F.col(child).alias("child")).join(one, "node", "left_semi").select(place.alias("start"), F.col("child").alias("node")).distinct()
    if blocked is not None:
        entry = entry.join(blocked.select("node"), "node", "left_anti")
    first = written(entry.select("node").filter("node is not null").distinct(), "entry")
    found, front = [first], first
    e = _edges(edges, parent, child)
    while True:
        new = front.join(e, front["node"] == e["parent"]).select(F.col("child").alias("node")).distinct()
        for known in ([blocked.select("node")] if blocked is not None else []) + found:
            new = new.join(known, "node", "left_anti")
        front = written(new, "reached")
        if front.isEmpty():
            break
        found.append(front)
        if len(found) > 8:
            found = [written(_union(found), "reached")]
    return _union(found).join(one, "node", "left_anti")


def layers(edges: DataFrame, nodes: DataFrame | None = None, parent: str = "parent", child: str = "child", node: str = "node", max_rounds: int = 10_000) -> DataFrame:
    """(node, layer): a node without parents is in layer 0, any other one after the last of its parents. A cycle is an error
    that names some of its nodes. nodes: further ones, without edges."""
    left = _edges(edges, parent, child)
    every = left.select(F.col("parent").alias("node")).union(left.select("child"))
    if nodes is not None:
        every = every.union(nodes.select(node).filter(F.col(node).isNotNull()))
    todo = written(every.distinct(), "nodes")
    found: list[DataFrame] = []
    for number in range(max_rounds):
        ready = written(todo.join(left.select(F.col("child").alias("node")).distinct(), "node", "left_anti"), "ready")
        if ready.isEmpty():
            break
        found.append(ready.withColumn("layer", F.lit(number)))
        before, gone = todo, left
        todo = written(todo.join(ready, "node", "left_anti"), "nodes")
        left = written(left.join(ready.select(F.col("node").alias("parent")), "parent", "left_anti"), "edges")
        drop_tables(before, gone)
    else:
        raise RuntimeError(f"there are layers left after {max_rounds} rounds")
    if not todo.isEmpty():
        some = [str(r["node"]) for r in todo.orderBy("node").limit(10).collect()]
        raise ValueError(f"the edges have a cycle through, or above, {', '.join(some)}")
    return _union(found) if found else todo.withColumn("layer", F.lit(0))
