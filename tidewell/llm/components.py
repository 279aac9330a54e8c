"""Connected components of a table of links, by rounds of large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, stored
from .spread import looked_up


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that links reach, for every node that has a link.

    Links are undirected; loops, nulls and repeats are ignored. Each round aggregates by node (partial aggregates first, so a
    hub's links are reduced before they move), a hub's links are dealt out in slices where they are joined, and the lineage is cut by a
    table in the shared folder. The number of rounds grows with the logarithm of the longest chain.
    """
    edges = stored(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct(),
        "links",
    )
    was = _told(edges)
    while was[0]:
        # Large star: each node's larger neighbours join its smallest neighbour.
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("links"))
        large = looked_up(both.where("v > u"), least, ["u"], "links", 2 * was[0], "inner").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: each node's smaller neighbours and itself join the smallest of them.
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        new = stored(small.select("e.*").where("u <> v").distinct(), "links")
        discard(edges)
        edges, before, was = new, was, _told(new)
        if was == before:
            break
    found = edges.groupBy("u").agg(F.min("v").alias("component"))
    return found.select(F.col("u").alias("node"), "component").union(edges.select("v", F.col("v").alias("c")).distinct())


def _told(edges: DataFrame) -> tuple:
    """The number of links, and a sum that tells whether they have changed."""
    return tuple(edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(20,0)"))).first())
