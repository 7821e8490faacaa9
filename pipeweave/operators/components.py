"""Connected components of an undirected graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipeweave.storage import Scratch


def _least(edges: DataFrame) -> DataFrame:
    """The least neighbour of each node u, or u itself where that is less."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) links to (node, component_id): the smallest node reachable. Nodes without links have no row.

    Each round joins every edge to its node's least neighbour; minima are pre-aggregated before the
    shuffle, and a join whose other side has one row a key can be split where a key is hot. Rounds
    grow with the logarithm of the longest path. Edges are written once a round and compared by a
    count and an order-free sum of hashes, so nothing but two numbers reaches the driver.
    Null ends and self-links are ignored; no links give no rows.
    """
    edges = scratch.keep(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(_least(large), "u")
        new = (
            small.select("u", F.col("m").alias("v"))
            .unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
            .distinct()
        )
        new = scratch.keep(new, "edges")
        state = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(edges)
        edges = new
        if seen == state or state[0] == 0:
            break
        seen = state
    least = edges.select(F.col("u").alias("node"), F.col("v").alias("component_id"))
    return least.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component_id")).distinct())
