"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node that links lead to) for each node of links(a, b).

    Rounds of large stars and small stars: every node hands its neighbours to the least one it knows, so paths halve
    and the links never grow in number beyond what came in. A round's links are written to the shared folder; only
    their count and a checksum come to the driver. Null ends are left out."""
    edges = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = staged(edges, "links")
    before = None
    while True:
        # Large star: larger neighbours of a node link to its least neighbour (or itself).
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # Small star: a node and its smaller neighbours link to the least of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionByName(low.select("a", F.col("m").alias("b")))
        edges = staged(small.distinct(), "links")
        now = tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first())
        if now == before:
            break
        before = now
    top = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return top.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
