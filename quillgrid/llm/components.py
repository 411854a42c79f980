"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def _stars(pairs: DataFrame) -> bool:
    """Whether every larger node has one smaller one, which has none itself: then the pairs are the components, and a round would change none."""
    ends = pairs.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(pairs.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    per = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not per.where("up + down > 1").limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links -> (node, component): the smallest node reachable from each node that has a link.

    Every round turns each node's neighbourhood into a star around its smallest neighbour, first for the
    larger neighbours, then for the smaller ones (the "large star / small star" scheme); the number of rounds
    grows with the logarithm of the largest component and only (node, node) pairs are ever shuffled. A round
    ends in a table in the shared folder, and the tables before it are deleted; rounds end as soon as all are stars. The
    result is a table, too. Minima are aggregated map-side and joined back, so a node with very
    many neighbours is never gathered in one task. Nulls and self-links are ignored; no edges give no rows.
    """
    pairs = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _stars(pairs):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cut(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        drop(pairs, low, large)
        pairs = after
    own = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = cut(pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own))
    drop(pairs)
    return out
