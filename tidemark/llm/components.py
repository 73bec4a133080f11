"""Connected components of an edge table, by rounds of hooking to the least neighbour and contraction.

No links are collected: each round is joins and pre-aggregated groupings, and ends in a table in the
shared folder. A round at least halves the roots that still have edges, and a path of any length is
shortened by doubling, so rounds grow with the logarithm of the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.session import release, settle, small


def _jump(parents: DataFrame) -> DataFrame:
    """Point every node to the root of its tree (roots have no row), doubling paths until none changes."""
    while True:
        up, before = small(parents).select(F.col("node").alias("parent"), F.col("parent").alias("next")), parents
        parents = settle(parents.join(up, "parent", "left").select("node", F.coalesce("next", "parent").alias("parent"), F.col("next").isNotNull().alias("moved")), "parents")
        release(before)
        if parents.where("moved").isEmpty():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """(node, component), settled: for every node with an edge to another node, the least node it can reach.

    edges: columns a, b (long). Null ends and loops count as no edge; repeated edges do no harm.
    """
    edges = settle(edges.select("a", "b").where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found = settle(edges.limit(0).select(F.col("a").alias("node"), F.col("b").alias("component")), "found")
    while not edges.isEmpty():
        parents = _jump(settle(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent")), "hooks"))
        # a node with only larger neighbours is a root here; others hang below it
        near = small(parents).select("node", "parent")
        told = found.join(near.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("parent", "component").alias("component"))
        old, edge_rows = found, edges
        found = settle(told.unionByName(parents.join(found.select("node"), "node", "left_anti").select("node", F.col("parent").alias("component"))), "found")
        for side in ("a", "b"):
            edge_rows = edge_rows.join(near.select(F.col("node").alias(side), F.col("parent").alias(f"root_{side}")), side, "left")
        moved = edge_rows.select(F.coalesce("root_a", "a").alias("x"), F.coalesce("root_b", "b").alias("y")).where("x <> y")
        before, edges = edges, settle(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        release(before, parents, old)
    release(edges)
    return settle(found.unionByName(found.select(F.col("component").alias("node"), "component").distinct()), "components")
