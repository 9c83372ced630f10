"""Connected components of links between integers, by alternating stars over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import materialize

#: Nodes of at most so many links need no splitting in a join.
BUSY = 1000


def _with_least(links: DataFrame, least: DataFrame, n_links: int) -> DataFrame:
    """``links`` with ``m`` of their ``u``, by a merge join: the driver would hold the broadcasts of every round until its garbage
    is collected. Where a node may be busy ``least`` is written before, so that both sides are plain shuffles and Spark splits
    what the links of a family's centre make large. ``n_links`` is half of the rows of ``links`` at least."""
    if 2 * n_links > BUSY:
        least = materialize(least, "least")
    return links.join(least.hint("merge"), "u")


def _counted(edges: DataFrame) -> tuple[int, int]:
    """The number of ``edges`` (u, v) with u > v, and of nodes that keep them from being stars around their least nodes:
    these have several edges as ``u``, or edges as ``u`` and as ``v``."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).union(edges.select("v", F.lit(0)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count(F.lit(1)).alias("n"))
    n, odd = nodes.agg(F.sum("up"), F.count_if((F.col("up") > 0) & (F.col("n") > 1))).first()
    return n or 0, odd


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``links`` (u, v); a component is named by its least node.

    A large star points every larger neighbour of a node to the least one around it, a small star does
    so for the smaller ones; the rounds needed grow with the logarithm of the longest path, and links that are stars
    need none. Both stars of each round are written to the shared folder, so that no plan holds one inside the
    other. Loops and repeated links are allowed; nodes without a link are absent.
    """
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    edges = materialize(edges, "links")
    while True:
        n_links, odd = _counted(edges)
        if not odd:
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = _with_least(both, least, n_links).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialize(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_least(large, least, n_links).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("e"))
        edges = materialize(small.select("e.u", "e.v").filter("u <> v").distinct(), "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
