"""Connected components of a table of links, by alternating large-star and small-star steps.

Every step joins links with the least neighbour of each node, a partially aggregated minimum: no task
ever holds the neighbours of a node as a list. The links of each round are written to the shared
folder, so that lineage stays short and a lost executor costs one step. It ends when every
node is linked to the least node of its component, after a logarithmic number of rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import base


def components(links: DataFrame) -> DataFrame:
    """node, label: the least node reachable, for every node of a link (a, b) but the least itself."""
    edges = base.stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "links",
    )
    seen = _state(edges)
    while True:
        edges = base.stored(_small_star(_large_star(edges)), "links")
        now = _state(edges)
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        seen = now


def _state(edges: DataFrame) -> tuple:
    """A fingerprint of the set of links: two sets of equal fingerprints are taken as equal."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(h, 24)), F.bit_xor(h)).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node, linked to the least node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours, linked to the least of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    smaller = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return smaller.unionByName(least.withColumnRenamed("m", "v")).distinct()
