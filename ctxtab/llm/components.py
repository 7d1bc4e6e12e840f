"""Connected components of an undirected link table by alternating star contraction.

Every round is two joins: the large-star step points all larger neighbours of a node at the
smallest node it knows, the small-star step the smaller ones.  Links only ever shrink towards
the smallest node of their component, so a few rounds (logarithmic in its size) end in stars.
Neighbour lists are never gathered: a node's minimum is an aggregate, and the join that brings
it back can be split by Spark where a node has very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxtab.session import cut_lineage


def _minimum(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _minimum(both).select("u", F.least("u", "m").alias("m"))
    return (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct())


def _small_star(links: DataFrame) -> DataFrame:
    low = _minimum(links)
    return (links.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))).distinct())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of ``links``; ``root`` is the smallest node of its component.

    Links with a null end or equal ends, repeated and reversed links change nothing; a node whose
    only links are such is not in the result.  Empty table: empty result.
    """
    now = cut_lineage(links.where(F.col(a) != F.col(b))
                      .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == state or not seen[0]:
            break
        state = tuple(seen)
        now = cut_lineage(_small_star(_large_star(now)))
    return (now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct())
