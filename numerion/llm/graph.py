"""Connected components of an edge list, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from numerion.llm.common import shared_table


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("w"))
    near = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "w").alias("v"))
    return near.where("u > v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Takes and gives edges with u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("w"))
    moved = edges.join(least, "u").where("v > w").select(F.col("v").alias("u"), F.col("w").alias("v"))
    return moved.unionByName(least.select("u", F.col("w").alias("v"))).distinct()


def _print(edges: DataFrame) -> tuple:
    """A count and a checksum that tell two edge sets apart."""
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of ``edges`` (u, v) reaches.

    Nodes without an edge, and roots themselves, have no row. The number of rounds grows with
    the logarithm of the longest chain; a node's neighbours are reduced by
    partial aggregation, never gathered.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = shared_table(edges, "edges")
    seen = _print(edges)
    while seen[0]:
        edges = shared_table(_small_star(_large_star(edges)), "edges")
        now = _print(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
