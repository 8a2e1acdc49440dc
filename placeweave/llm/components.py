"""Connected components of a table of links, by alternating large and small stars.

Each step is a minimum per node (combined before the shuffle) and a join; links are never gathered anywhere, and the
links of a node that has very many are dealt to several tasks. The driver reads two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeweave.llm.shared import discard, join_hot, materialize

#: With fewer links no node has more than one task can take.
FEW = 1 << 20


def connected(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node of edges (a, b) reaches. Nodes without an edge are left out."""
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state, few = None, now.count() < FEW
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("size"))
        large = _joined(both, lowest, few).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = large if few else materialize(large, "links")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("size"))
        small = _joined(large, lowest, few).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, (now, last) = state, (materialize(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "links"), now)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()  # two numbers
        discard(last)
        few = state[0] < FEW
        if state == before:
            break
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _joined(links: DataFrame, lowest: DataFrame, few: bool) -> DataFrame:
    return links.join(lowest, "u") if few else join_hot(links, materialize(lowest, "lowest"), "u", size="size")
