"""Matching one triple pattern: a scan, a filter and a projection."""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleweft.functions.terms import (
    POSITIONS,
    is_encoded,
    is_variable,
    position_equals,
    position_key,
)

Pattern = tuple


def variables(pattern: Pattern) -> list[str]:
    """Variable names of a pattern, without the question mark, in order."""
    return list(dict.fromkeys(term[1:] for term in pattern if is_variable(term)))


def node_variables(patterns: Collection[Pattern]) -> set[str]:
    """Variables that stand for a node somewhere: as a subject or predicate.

    A literal can never be bound to them, so where they are objects of encoded
    triples they take the object's id.
    """
    return {term[1:] for s, p, _ in patterns for term in (s, p) if is_variable(term)}


def match_pattern(
    triples: DataFrame, pattern: Pattern, node_vars: Collection[str] | None = None
) -> DataFrame:
    """Bindings of one pattern: one column per variable, one row per match.

    `pattern` is `(s, p, o)`; "?x" is a variable and everything else a
    constant: text on raw triples, ids or literal text on encoded ones. A repeated variable is an equality filter.
    `node_vars` names variables that other patterns bind to nodes.
    """
    node_vars = node_variables([pattern]) if node_vars is None else node_vars
    where: dict[str, list[str]] = {}
    conditions: list[Column] = []
    for position, term in zip(POSITIONS, pattern):
        if is_variable(term):
            where.setdefault(term[1:], []).append(position)
        else:
            conditions.append(position_equals(triples, position, term))

    outputs: list[Column] = []
    for name, positions in where.items():
        first = positions[0]
        for other in positions[1:]:
            conditions.append(F.col(first) == position_key(triples, other))
        if first == "o" and name in node_vars:
            key = position_key(triples, "o")
            if is_encoded(triples):
                conditions.append(key.isNotNull())
            outputs.append((key if is_encoded(triples) else F.col("o")).alias(name))
        else:
            outputs.append(F.col(first).alias(name))

    matches = triples.where(reduce(Column.__and__, conditions)) if conditions else triples
    return matches.select(*outputs)
