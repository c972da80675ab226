"""Connected components of links between ids, by alternating large-star and small-star (Kiveris et al., 2014).

Each round joins every node to the smallest node it knows of; hubs are only ever aggregated, and rounds are written to
the shared folder, so lineage stays short. The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def stars(links: DataFrame) -> DataFrame:
    """hi, lo of links (a, b): every node but the smallest of its component, once, with that smallest node."""
    links = links.where(F.col("a") != F.col("b"))
    edges = written(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    seen = _print(edges)
    while seen[0]:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        # hi's neighbours below it reach their smallest through (v, m); a node's own smallest follows from its edge to it.
        large = edges.join(least.withColumnRenamed("u", "lo"), "lo").select("hi", F.col("m").alias("lo")).distinct()
        smallest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(smallest, "hi")
        after = small.select("hi", F.col("m").alias("lo")).unionByName(small.where(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))).distinct()
        edges = written(after, "edges")
        now = _print(edges)
        if now == seen:
            break
        seen = now
    return edges
