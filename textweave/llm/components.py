"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textweave.llm.common import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b), root being the least node reachable.

    Each node points at its least neighbour, pointers are doubled until they end at roots, and edges
    between different roots form the next, smaller graph; a star takes one turn. Every turn is written
    to the shared checkpoint folder. Self-links and repeated edges don't matter. Nothing but row counts
    reaches the driver.
    """
    edges = materialise(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = None
    while edges.count():
        both = edges.select(F.col("b").alias("node"), F.col("a").alias("near")).unionByName(edges.select(F.col("a").alias("node"), F.col("b").alias("near")))
        roots = materialise(both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("root")))
        while True:
            over = roots.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
            doubled = materialise(roots.join(over, roots["root"] == over["_n"]).select("node", F.col("_r").alias("root"), (F.col("_r") != roots["root"]).alias("_moved")))
            moved = doubled.filter("_moved").limit(1).count()
            roots = doubled.drop("_moved")
            if not moved:
                break
        if found is None:
            found = roots
        else:
            step = roots.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
            found = materialise(found.join(step, found["root"] == step["_n"], "left").select("node", F.coalesce("_r", "root").alias("root")))
        a, b = (roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in "ab")
        edges = edges.join(a, "a").join(b, "b").filter("a_root <> b_root")
        edges = materialise(edges.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct())
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found
