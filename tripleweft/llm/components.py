"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleweft.llm.runtime import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """`node, component` for every node of `links` (`a, b`); the smallest node names the component.

    Alternating large-star and small-star steps. A node's neighbours are never
    gathered: each step needs only the smallest, which combines map-side, and
    an equi-join on it, whose hot nodes adaptive execution splits. The links of
    every round are written.
    """
    stars = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # every larger neighbour of a node is tied to the node's smallest neighbour
        large = both.join(_smallest(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # every smaller neighbour of a node, and the node, to its smallest one
        down = large.where("b < a")
        small = down.join(_smallest(down), "a").select(F.explode(F.array(F.col("a"), F.col("b"))).alias("a"), F.col("m").alias("b"))
        stars = materialize(small.where("b < a").distinct(), "links")
        state = stars.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            break
        seen = state
    roots = stars.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _smallest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
