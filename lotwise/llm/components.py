"""Connected components of a link table by alternating star contraction.

A round links every node to the smallest node of its neighbourhood, first among the larger neighbours,
then among the smaller ones. The number of links never grows, and after about log(n) rounds each
component is a star around its smallest node. Every step is a grouped minimum and an equality join,
so a node with very many links is pre-aggregated and its join partition can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.session import via_table


def _stars(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    # Larger neighbours go to the smallest of the neighbourhood.
    large = (
        both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
    )
    # Then each node and its smaller neighbours.
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (columns ``a``, ``b``); the root is its smallest node.

    Links to itself and repeated links count for nothing. Nodes without links are not in the result.
    """
    state, seen = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), None
    while True:
        state = via_table(state, "links")
        now = state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.shiftright(F.xxhash64("b", "a"), 20))).first()
        if now == seen or not now[0]:
            break
        seen, state = now, _stars(state)
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        state.select(F.col("b").alias("node"), F.col("b").alias("root"))
    ).distinct()
