"""Connected components by repeated contraction, all of it in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _jump(hook: DataFrame) -> DataFrame:
    """Points each node at the root of its chain; chains halve with each pass. Parents are smaller than their nodes, so chains end."""
    while True:
        up = hook.select(F.col("node").alias("mid"), F.col("parent").alias("top"))
        moved = common.materialize(hook.join(up, hook["parent"] == up["mid"], "left").select("node", F.coalesce("top", "parent").alias("parent"), F.col("top").isNotNull().alias("moved")), "hook")
        hook = moved.select("node", "parent")
        if moved.where("moved").isEmpty():
            return hook


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b): root is a node of the same component, one for each component.

    Each round every node hooks onto its smallest smaller neighbour, chains are shortened to their roots, and edges
    are redrawn between roots until none is left. Sums are formed before shuffles, so a node with very many edges is
    no group of its own anywhere. Self-loops and repeated edges change nothing; no edges: no rows.
    """
    edges = common.materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
    hooks: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("parent"))
        hook = _jump(common.materialize(both.groupBy("node").agg(F.min("parent").alias("parent")), "hook"))
        hooks.append(hook)
        at = edges
        for c in ("a", "b"):
            to = hook.select(F.col("node").alias(f"_{c}"), F.col("parent").alias(f"{c}_root"))
            at = at.join(to, at[c] == to[f"_{c}"], "left").drop(f"_{c}").withColumn(c, F.coalesce(f"{c}_root", c)).drop(f"{c}_root")
        edges = common.materialize(at.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if not hooks:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root"))
    found = hooks[0].select("node", F.col("parent").alias("root"))
    for hook in hooks[1:]:
        # A root of an earlier round may hook in a later one, and later rounds name no other nodes.
        up = hook.select(F.col("node").alias("mid"), F.col("parent").alias("top"))
        found = found.join(up, found["root"] == up["mid"], "left").select("node", F.coalesce("top", "root").alias("root"))
        found = found.unionByName(hook.select("node", F.col("parent").alias("root")))
    found = common.materialize(found.groupBy("node").agg(F.min("root").alias("root")), "components")
    roots = found.select(F.col("root").alias("node"), "root").distinct().join(found.select("node"), "node", "left_anti")
    return found.unionByName(roots)
