"""Connected components by contraction, as joins on stored tables.

Each round points every node at its smallest neighbour, follows the pointers to their roots by doubling, and
replaces the nodes of all links by their roots.  Links inside a root disappear; rounds end when none is
left.  Nothing is collected: only counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridkin.operators.storage import write_and_read


def _roots(pointers: DataFrame) -> DataFrame:
    """``(node, to)`` with every ``to`` a node that points at itself.  Pointers lead to smaller nodes only."""
    while True:
        far = pointers.select(F.col("node").alias("to"), F.col("to").alias("next"))
        jumped = pointers.join(far, "to", "left").select(
            "node", F.coalesce("next", "to").alias("to"), (F.coalesce("next", "to") != F.col("to")).alias("moved")
        )
        stored = write_and_read(jumped, "pointers")
        pointers = stored.select("node", "to")
        if stored.where("moved").limit(1).count() == 0:
            return pointers


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for all nodes of the links ``(a, b)``; the root is the least node of its component."""
    links = write_and_read(links.select("a", "b").where(F.col("a") != F.col("b")).distinct(), "links")
    nodes = write_and_read(links.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    roots = nodes.select("node", F.col("node").alias("root"))
    while links.limit(1).count():
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to"))
        to = _roots(write_and_read(least.select("node", F.least("node", "to").alias("to")), "pointers"))
        moved = to.select(F.col("node").alias("root"), F.col("to").alias("new"))
        roots = write_and_read(
            roots.join(moved, "root", "left").select("node", F.coalesce("new", "root").alias("root")), "roots"
        )
        ends = to.select(F.col("node").alias("a"), F.col("to").alias("x"))
        other = to.select(F.col("node").alias("b"), F.col("to").alias("y"))
        contracted = links.join(ends, "a").join(other, "b").where(F.col("x") != F.col("y"))
        links = write_and_read(
            contracted.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links"
        )
    return roots
