"""Counts over triples and bindings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dataset_stats(triples: DataFrame) -> DataFrame:
    """One row: number of triples and of distinct properties."""
    return triples.agg(
        F.count(F.lit(1)).alias("n_triples"), F.count_distinct("p").alias("n_properties")
    )


def property_stats(triples: DataFrame) -> DataFrame:
    """Per property: triples, share of all triples, distinct s and o.

    The total is a scalar subquery over the same aggregate, whose exchange
    Spark reuses, so the triples are read once.
    """
    stats = triples.groupBy("p").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("s").alias("n_s"),
        F.count_distinct("o").alias("n_o"),
    )
    total = stats.agg(F.sum("n").alias("total")).scalar()
    return stats.withColumn("ratio", F.col("n").cast("double") / total).select(
        "p", "n", "ratio", "n_s", "n_o"
    )


def distinct_terms(triples: DataFrame, col: str, by_property: bool = False) -> DataFrame:
    """Distinct values of s, p or o, overall or within each property."""
    columns = ["p", col] if by_property and col != "p" else [col]
    return triples.select(*columns).distinct()


def count_results(bindings: DataFrame) -> DataFrame:
    """One row: number of solutions."""
    return bindings.agg(F.count(F.lit(1)).alias("n_results"))
