"""Connected components of an edge table, by rounds of random contraction.

In each round every node points at the neighbour (or itself) with the smallest hash; edges are then drawn between the
nodes pointed at, without loops and repeats. A constant share of nodes goes in each round, so rounds grow with the
logarithm of the graph, even for long chains. Rounds are written to the shared folder, which cuts lineage, and are deleted
when the components are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.storage import drop_tables, written


def connected_components(edges: DataFrame, left: str = "left_id", right: str = "right_id", max_rounds: int = 100) -> DataFrame:
    """One row (node, root) for each node of an edge; nodes are connected if and only if their roots are equal.

    Ids must be integers or strings; edges with a null end are left out, and loops make their node a component.
    """
    pairs = written(edges.select(F.col(left).alias("a"), F.col(right).alias("b")).filter("a is not null and b is not null").distinct(), "edges")
    live = pairs.filter("a <> b")
    trees: list[DataFrame] = []
    for number in range(max_rounds):
        if live.isEmpty():
            break
        order = lambda c: F.struct(F.xxhash64(c, F.lit(number)).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        both = live.select("a", order("b").alias("to")).union(live.select(F.col("b").alias("a"), order("a").alias("to")))
        least = both.groupBy("a").agg(F.min("to").alias("to"))
        tree = written(least.select(F.col("a").alias("node"), F.least(order("a"), F.col("to"))["n"].alias("up")), "tree")
        trees.append(tree)
        first = live.join(tree, live["a"] == tree["node"]).select(F.col("up").alias("a"), "b")
        second = first.join(tree, first["b"] == tree["node"]).select("a", F.col("up").alias("b"))
        before = live
        live = written(second.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        if number:
            drop_tables(before)
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    alone = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().select("node", F.col("node").alias("root"))
    if not trees:
        found = written(alone, "components")
        drop_tables(pairs)
        return found
    labels = trees[-1].select("node", F.col("up").alias("root"))
    for tree in reversed(trees[:-1]):
        deeper = labels.withColumnRenamed("node", "up")
        labels = tree.join(deeper, "up", "left").select("node", F.coalesce("root", "up").alias("root"))
    found = written(alone.join(labels.withColumnRenamed("root", "found"), "node", "left").select("node", F.coalesce("found", "root").alias("root")), "components")
    drop_tables(pairs, live, *trees)
    return found


def component_labels(nodes: DataFrame, edges: DataFrame, node_id: str = "record_id", left: str = "left_id", right: str = "right_id") -> DataFrame:
    """Add component_id, the smallest id of the node's component; nodes without edges are components of their own.

    Edges may name ids that are not among the nodes; those still connect others.
    """
    roots = connected_components(edges, left, right)
    least = roots.groupBy("root").agg(F.min("node").alias("least"))
    named = roots.join(least, "root").select(F.col("node").alias("_node"), "least")
    return nodes.join(named, nodes[node_id] == F.col("_node"), "left").withColumn("component_id", F.coalesce("least", F.col(node_id))).drop("_node", "least")


def merge_components(components: DataFrame | None, links: DataFrame, left: str = "left_id", right: str = "right_id") -> DataFrame:
    """Components (node, component_id, the smallest node) after further links; None stands for no components yet.

    Links become edges between the components of their ends, and only those are contracted: the work grows with the links,
    but for one pass over the table. Links with a null end are left out.
    """
    edges = links.select(F.col(left).alias("a"), F.col(right).alias("b")).filter("a is not null and b is not null").distinct()
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    if components is None:
        return component_labels(ends, edges, "node", "a", "b")
    edges, ends = written(edges, "new-links"), written(ends.join(components.select("node", F.col("component_id").alias("old")), "node", "left"), "new-ends")
    at = ends.select("node", F.coalesce("old", "node").alias("at"))
    for side in ("a", "b"):
        edges = edges.join(at.withColumnsRenamed({"node": side, "at": f"at_{side}"}), side)
    touched = at.select(F.col("at").alias("component")).distinct()
    changes = written(component_labels(touched, edges, "component", "at_a", "at_b"), "component-changes")
    old = components.join(changes.select(F.col("component").alias("component_id"), F.col("component_id").alias("new")), "component_id", "left")
    fresh = ends.filter("old is null").join(changes.withColumnsRenamed({"component": "node"}), "node").select("node", "component_id")
    return old.select("node", F.coalesce("new", "component_id").alias("component_id")).unionByName(fresh)
