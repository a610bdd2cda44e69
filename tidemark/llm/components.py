"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import stored


def components(links: DataFrame, purpose: str = "components") -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is one node of its component.

    Each round every node points to its least neighbour (or itself), and the links are drawn
    between the nodes pointed to; links within one node vanish. Node numbers should be hashes: then
    a round removes a fixed share of the nodes on average, and links shrink as fast. Only one number
    per node is joined to the links, so a hub's links never meet in one task (the join splits a hot
    side). Each round is stored. Links of a node to itself are ignored, repeated ones count once; a
    table without links gives no rows.
    """
    edges = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        purpose)
    roots = None
    while True:
        near = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), purpose)
        if roots is None:
            roots = least.select(F.col("a").alias("node"), F.col("m").alias("root"))
        else:
            step = least.withColumnRenamed("a", "root")
            roots = stored(roots.join(step, "root", "left").select("node", F.coalesce("m", "root").alias("root")), purpose)
        drawn = (
            edges.join(least, "a").select("b", F.col("m").alias("u"))
            .join(least.withColumnRenamed("a", "b"), "b").select("u", F.col("m").alias("v")).where("u <> v")
        )
        edges = stored(drawn.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct(), purpose)
        if edges.isEmpty():
            return roots
