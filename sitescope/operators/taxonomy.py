"""Hierarchies given by parent links: ancestors of every node, cycles, searches that include children.

Links are followed by doubling: after k rounds a node knows what stands 2^k links above it,
so a chain of any depth takes as many rounds as its length has binary digits. Every round is a
join on the node, written to the shared folder. A child whose parent is not in the table is a root.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitescope.session import checkpointed


@dataclass(frozen=True)
class Hierarchy:
    """``closure``: (ancestor, node, depth), each node at depth 0 of itself; ``cycles``: (node) on a cycle."""

    closure: DataFrame
    cycles: DataFrame


def _links(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """(node, above): the links between nodes that both exist; repeated nodes keep their smallest parent."""
    rows = nodes.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("node")).agg(F.min(parent).alias("above"))
    return rows.join(rows.select(F.col("node").alias("above")), "above", "left_semi").select("node", "above")


def _doubled(jump: DataFrame) -> DataFrame:
    """From what stands n links above each node to what stands 2 n above."""
    further = jump.select(F.col("node").alias("above"), F.col("above").alias("_top"))
    return jump.join(further, "above").select("node", F.col("_top").alias("above"))


def cyclic_nodes(links: DataFrame) -> DataFrame:
    """(node) on a cycle: what is still reached after as many links as there are nodes."""
    longest, reach, jump = links.count(), 1, links
    while reach <= longest:
        jump, reach = checkpointed(_doubled(jump)), reach * 2
        if jump.isEmpty():
            break
    return checkpointed(jump.select(F.col("above").alias("node")).distinct())


def hierarchy(nodes: DataFrame, key: str = "industry_id", parent: str = "parent_id") -> Hierarchy:
    """Ancestors of all nodes. Nodes on a cycle are reported and count as roots, so what hangs below keeps its place."""
    links = checkpointed(_links(nodes, key, parent))
    cycles = cyclic_nodes(links)
    jump = checkpointed(links.join(cycles, "node", "left_anti"))
    own = nodes.where(F.col(key).isNotNull()).select(F.col(key).alias("node")).distinct()
    closure = checkpointed(own.select(F.col("node").alias("ancestor"), "node", F.lit(0).alias("depth")))
    reach = 1
    while not jump.isEmpty():
        # The closure has all ancestors less than ``reach`` above; those of what stands ``reach`` above come on top.
        upper = closure.select(F.col("node").alias("above"), "ancestor", "depth")
        more = jump.join(upper, "above").select("ancestor", "node", (F.col("depth") + reach).alias("depth"))
        closure = checkpointed(closure.union(more))
        jump, reach = checkpointed(_doubled(jump)), reach * 2
    return Hierarchy(closure, cycles)


def within(rows: DataFrame, closure: DataFrame, wanted: list, column: str = "industry_id") -> DataFrame:
    """Rows whose node is one of the wanted ones or stands below one; each row once.

    ``wanted`` are the few nodes of a request; the nodes below them are joined, not listed.
    """
    below = closure.where(F.col("ancestor").isin(wanted)).select(F.col("node").alias(column)).distinct()
    return rows.join(below, column, "left_semi")


def totals(rows: DataFrame, closure: DataFrame, column: str = "industry_id") -> DataFrame:
    """(node, own, total): rows of each node, and with those of all nodes below; added up by node before they climb."""
    own = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("node")).agg(F.count("*").alias("n"))
    climbed = closure.join(own, "node").groupBy("ancestor").agg(
        F.coalesce(F.sum(F.when(F.col("depth") == 0, F.col("n"))), F.lit(0)).alias("own"), F.sum("n").alias("total")
    )
    return climbed.select(F.col("ancestor").alias("node"), "own", "total")
