"""Connected components of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from footfall.llm.common import stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each node to the least of them and the node.

    The large step links the larger neighbours, the small step the node and its smaller neighbours.
    """
    if large:
        edges = edges.union(edges.select("v", "u"))
        least = edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        out = edges.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
    return out.where("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """For each end of a link (columns u, v; long), the least node that it reaches: columns node, root.

    Links may repeat, and a link of a node with itself gives nothing. No links give no rows. Each round is written
    to the shared folder; a node with very many links is aggregated before it is shuffled, and Spark can split its join.
    """
    edges = stored(links.where("u != v").distinct(), "links")
    before = None
    while True:
        # Contraction is over when the links, all of them (node, root), no longer change.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
        edges = stored(_stars(_stars(edges, large=True), large=False), "links")
