"""Connected components of a link table, by alternating large and small stars.

A large star joins every larger neighbour of a node to its smallest neighbour, a small star every smaller one. Both keep
the components and end with each node joined to the smallest of its own. Minima are aggregated before the shuffle; the
join that hands them back can be split by AQE where one node has very many links. Each round's links are written to the shared folder, which cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.llm.common import Scratch


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: (u, v), u > v. The same shape after one star."""
    near = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    low = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    met = near.join(low, "u")
    if large:
        out = met.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") > F.col("v")).distinct()


def components(links: DataFrame, a: str, b: str, scratch: Scratch) -> DataFrame:
    """(node, component) for every node with a link to another; component is the smallest node it can reach."""
    u, v = F.col(a).cast("long"), F.col(b).cast("long")
    now, path = scratch.write(links.filter(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    mark = lambda d: tuple(d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = mark(now)
    while seen[0]:  # ends: stars only ever join nodes to smaller ones
        after, to = scratch.write(_star(_star(now, True), False))
        scratch.drop(path)
        now, path, was, seen = after, to, seen, mark(after)
        if seen == was:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
