"""Joining bindings and semi-joins that stay balanced under hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleweft.functions.terms import as_id
from tripleweft.operators.patterns import Pattern, match_pattern
from tripleweft.session import is_small, materialize
from tripleweft.sources.properties import PropertyStore, all_rows, only_properties

# Repeating a row n times goes through arrays; two levels keep them short.
_REPEAT_BLOCK = 65_536


def join_bindings(a: DataFrame, b: DataFrame, allow_product: bool = False) -> DataFrame:
    """Inner equi-join on every shared variable.

    Bindings without columns come from a fully bound pattern and only carry a
    number of matches: each row of the other side is repeated that often. A
    variable that one side binds as an id and the other as text, as an object
    that may be a literal, is joined as an id. Two
    sides that share nothing make a cartesian product, which is refused
    unless it is asked for.
    """
    shared = [name for name in a.columns if name in b.columns]
    if shared:
        a, b = _same_kind(a, b, shared)
        return a.join(b, shared)
    if not b.columns:
        return repeat_rows(a, b)
    if not a.columns:
        return repeat_rows(b, a)
    if not allow_product:
        raise ValueError(
            f"{a.columns} and {b.columns} share no variable; pass allow_product=True "
            "if every combination of rows is wanted"
        )
    return _product(a, b)


def _product(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every combination of rows; a side that is small by a count goes to the other one's tasks.

    Both are written first unless `b` is small: a product of two large sides
    reads each of them many times, and the written rows are few and narrow
    where the triples behind them are not.
    """
    b = materialize(b, "product")
    if is_small(b):
        return a.crossJoin(F.broadcast(b))
    a = materialize(a, "product")
    if is_small(a):
        return F.broadcast(a).crossJoin(b)
    return a.crossJoin(b)


def _same_kind(a: DataFrame, b: DataFrame, shared: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with ids where one has ids and the other text; literals drop out."""
    kinds = dict(a.dtypes), dict(b.dtypes)
    for name in shared:
        if {kinds[0][name], kinds[1][name]} == {"bigint", "string"}:
            a, b = (side.withColumn(name, as_id(side, name)) for side in (a, b))
    return a, b


def repeat_rows(rows: DataFrame, matches: DataFrame) -> DataFrame:
    """Each row as often as `matches` has rows; none if it has none."""
    n = matches.agg(F.count(F.lit(1)).alias("n")).scalar()
    block, last = F.lit(_REPEAT_BLOCK), F.col("_n") - F.col("_block") * F.lit(_REPEAT_BLOCK)
    blocks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / block)))
    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(block.cast("bigint"), last)))
    return (
        rows.withColumn("_n", n)
        .where(F.col("_n") > 0)
        .withColumn("_block", blocks)
        .withColumn("_copy", copies)
        .drop("_n", "_block", "_copy")
    )


def join_unbound_property(
    triples: DataFrame | PropertyStore,
    pattern: Pattern,
    bindings: DataFrame,
    properties: DataFrame | None = None,
    node_vars: set[str] | None = None,
) -> DataFrame:
    """Join a pattern whose predicate is a variable to other bindings.

    All properties are read, or only those in `properties` (column `p`).
    """
    if properties is not None:
        triples = only_properties(triples, properties)
    return join_bindings(bindings, match_pattern(all_rows(triples), pattern, node_vars))


def semi_join(
    rows: DataFrame, key: Column, keys: DataFrame, residual: Column | None = None
) -> DataFrame:
    """Rows whose `key` occurs in the `key` column of `keys`, which may repeat.

    The join is on the key and its hash. `keys` is made distinct by an
    aggregate on the key; a join on the key alone would read it without an
    exchange of its own, and adaptive execution splits a hot key of `rows`
    only between two exchanges. With the hash both sides get one, and the sort
    compares numbers before it compares text.
    """
    right = keys.distinct().withColumnRenamed("key", "_right_key")
    other = F.col("_right_key")
    condition = (F.xxhash64(key) == F.xxhash64(other)) & (key == other)
    if residual is not None:
        condition = condition & residual
    return rows.join(right, condition, "left_semi")


def semi_join_or_null(
    rows: DataFrame, key: Column, keys: DataFrame, residual: Column | None = None
) -> DataFrame:
    """Rows whose `key` is null or occurs in the `key` column of `keys`, read once.

    A test by an outer join with the distinct keys. Rows without a key would
    all meet in one partition; they are spread by a hash of the row instead.
    """
    right = keys.distinct().withColumnRenamed("key", "_right_key").withColumn("_found", F.lit(True))
    other = F.col("_right_key")
    spread = F.when(key.isNull(), F.xxhash64(*rows.columns)).otherwise(F.xxhash64(key))
    condition = (spread == F.xxhash64(other)) & (key == other)
    if residual is not None:
        condition = condition & residual
    found = rows.join(right, condition, "left").where(key.isNull() | F.col("_found"))
    return found.select(*rows.columns)
