"""Connected components of a link table by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_table


def _order(c: str):
    """Nodes in a scattered order, so that long paths of ascending values shrink as fast as others."""
    return F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("node"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes in ``links`` (u, v): nodes have the same root if links join them.

    In each round a node goes to its first neighbour in a scattered order, or stays if it comes first itself; after one
    step of pointer jumping the links between what is left make the next round. A round leaves a fraction of the
    nodes, so the number of rounds grows with the logarithm of the links. Everything stays in written tables; the
    driver sees only whether links are left. Neighbours are combined before the shuffle, and joins read
    written tables, so Spark can split a node with many links.
    """
    links = write_table(links.select("u", "v").filter("u <> v"), "links")
    roots = None
    while roots is None or not links.isEmpty():
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = both.groupBy("u").agg(F.min(_order("v")).alias("best"))
        parent = F.when(F.col("best") < _order("u"), F.col("best.node")).otherwise(F.col("u"))
        step = write_table(first.select(F.col("u").alias("node"), parent.alias("up")), "parents")
        jump = step.select(F.col("node").alias("up"), F.col("up").alias("root"))
        step = write_table(step.join(jump, "up").select("node", "root"), "parents")
        if roots is None:
            roots = step
        else:
            moved = step.select(F.col("node").alias("root"), F.col("root").alias("_next"))
            roots = write_table(
                roots.join(moved, "root", "left").select("node", F.coalesce("_next", "root").alias("root")), "roots"
            )
        left = links
        for c in ("u", "v"):
            left = left.join(step.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")), c)
        links = write_table(
            left.select(F.col("u_root").alias("u"), F.col("v_root").alias("v")).filter("u <> v").distinct(), "links"
        )
    return roots
