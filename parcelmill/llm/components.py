"""Connected components of a table of links, by alternating stars.

Each round first joins every node's larger neighbours to its smallest neighbour,
then its smaller ones; the links become stars around the smallest node of each
component after a number of rounds that grows with the logarithm of the size.
All steps are aggregations and joins on the node, so a node with very many links
is combined before the shuffle and its join can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelmill.llm.common import written


def _smallest(links: DataFrame) -> DataFrame:
    """(node, low): the smallest of each node and its neighbours in ``links`` (node, other)."""
    return links.groupBy("node").agg(F.min("other").alias("low")).select(
        F.col("node").alias("of"), F.least("node", "low").alias("low")
    )


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array(F.struct("node", "other"), F.struct(F.col("other").alias("node"), F.col("node").alias("other")))).alias("l")).select("l.*")


def components(links: DataFrame, one: str = "a", other: str = "b") -> DataFrame:
    """(node, component) for every node with a link to another node; component is its smallest node.

    Links may be in any order, repeated, or from a node to itself. Without links there are no rows.
    """
    # Each link once, from the larger node to the smaller.
    current = written(
        links.select(F.greatest(one, other).alias("node"), F.least(one, other).alias("other")).where("node > other").distinct(), "links"
    )
    seen = None
    while True:
        both = _both_ways(current)
        large = both.join(_smallest(both), F.col("node") == F.col("of")).where("other > node").select(
            F.col("other").alias("node"), F.col("low").alias("other")
        )
        # Each node points at its smallest neighbour; the node's other smaller neighbours are joined to that.
        down = large.where("node > other").distinct()
        low = _smallest(down)
        moved = down.join(low, F.col("node") == F.col("of")).select(
            F.explode(
                F.array(F.struct(F.col("node"), F.col("low").alias("other")), F.struct(F.col("other").alias("node"), F.col("low").alias("other")))
            ).alias("l")
        ).select("l.*").where("node > other").distinct()
        current = written(moved, "links")
        # The links have settled when neither their number nor what they point at changes.
        now = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "other").cast("decimal(38,0)"))).first()
        if now == seen:
            return current.select("node", F.col("other").alias("component"))
        seen = now
