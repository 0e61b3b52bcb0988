"""Connected components of a link table, by rounds of hooking and contraction.

Each round every node that has a smaller neighbour is hooked to its smallest, which makes trees; their
paths are halved by pointer jumping until every node points to its root; then all links move to the
roots. A node that is left as a root twice has taken in another: if it had no smaller neighbour, its
neighbours all had one, and either they hooked to it, or to a smaller node that then is its neighbour
and takes it in the next round. So the nodes at least halve every two rounds, and a round's jumps are
logarithmic in its deepest tree. Lineage is cut by checkpoints; links and labels stay distributed, and
only whether any are left comes to the driver. A hub with very many links costs rows, not one task:
minima are pre-aggregated before their shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as c


def _ordered(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _rooted(hooks: DataFrame) -> tuple[DataFrame, int]:
    """hooks(a, to) with each `to` the root of its tree, and how many jumps that took."""
    jumps = 0
    while True:
        jumps += 1
        further = hooks.select(F.col("a").alias("to"), F.col("to").alias("next"))
        hooks = c.checkpointed(hooks.join(further, "to", "left").select("a", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        if hooks.where("moved").isEmpty():
            return hooks.drop("moved"), jumps


def label(links: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """links(a, b) -> (node, root): for each node of a link, its component's smallest node.

    Links to itself and repeated ones have no effect; nodes without links have no row; an empty
    table gives an empty result. Null ends must be filtered before. `rounds`, if given, takes the
    number of jumps of every round.
    """
    links = c.checkpointed(_ordered(links))
    labels = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root"))
    while not links.isEmpty():
        hooks, jumps = _rooted(links.groupBy("a").agg(F.min("b").alias("to")))
        if rounds is not None:
            rounds.append(jumps)
        labels = c.checkpointed(labels.join(hooks.select(F.col("a").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        for end, other in (("a", "b"), ("b", "a")):
            links = links.join(hooks.select(F.col("a").alias(end), "to"), end, "left").select(F.coalesce("to", end).alias(end), other)
        links = c.checkpointed(_ordered(links))
    return labels
