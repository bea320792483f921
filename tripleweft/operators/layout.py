"""Unions and physical layout of triple tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_properties(tables: Sequence[DataFrame]) -> DataFrame:
    """All rows of several property tables, duplicates kept."""
    return reduce(DataFrame.unionByName, tables)


def intersect_properties(a: DataFrame, b: DataFrame) -> DataFrame:
    """Properties (column `p`) found in both sets."""
    return a.select("p").intersect(b.select("p"))


def partition_by(df: DataFrame, col: str = "s", n: int | None = None) -> DataFrame:
    """Hash-partition by subject or by the join column; the rows are unchanged.

    Without a number of partitions, adaptive execution merges small ones and
    splits the one of a hot value.
    """
    return df.hint("rebalance", F.col(col)) if n is None else df.repartition(n, col)
