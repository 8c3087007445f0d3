"""Connected components of a graph given as a table of links, by alternating star contractions.

In a large star every larger neighbour of a node is linked to the node's smallest neighbour; in a small star the
smaller ones and the node itself are. Both keep components as they are, and in the end each node hangs on the
smallest node of its component. Links never leave the executors; the driver sees one count and one sum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchmart.llm.common import saved


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("small").alias("big"), F.col("big").alias("small")))
    least = both.groupBy("big").agg(F.min("small").alias("_least"))
    least = least.select(F.col("big").alias("small"), F.least("_least", "big").alias("_least"))
    # Rows of links are (big, small): small is the centre, big its larger neighbour.
    return links.join(least, "small").select("big", F.col("_least").alias("small"))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("big").agg(F.min("small").alias("_least"))
    moved = links.join(least, "big").select(F.col("small").alias("big"), F.col("_least").alias("small"))
    return moved.where(F.col("big") != F.col("small")).unionByName(least.select("big", F.col("_least").alias("small")))


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node that has a link; ``links`` has ``a, b`` of one ordered type."""
    ordered = links.where("a <> b").select(F.greatest("a", "b").alias("big"), F.least("a", "b").alias("small"))
    current, state = saved(ordered.distinct()), None
    while True:
        sums = current.agg(F.count("*"), F.sum(F.xxhash64("big", "small").cast("decimal(38,0)"))).first()
        if tuple(sums) == state:
            return current.select(F.col("big").alias("node"), F.col("small").alias("component")).unionByName(
                current.select(F.col("small").alias("node"), F.col("small").alias("component")).distinct()
            )
        state = tuple(sums)
        # A contraction never adds links, so their number bounds what is written next.
        current = saved(_small_star(_large_star(current).distinct()).distinct(), rows=sums[0])
