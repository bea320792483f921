"""Conjunctive queries over triple patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tripleweft.functions.terms import is_encoded, is_variable
from tripleweft.operators.joins import join_bindings
from tripleweft.operators.patterns import Pattern, match_pattern, node_variables, variables
from tripleweft.operators.reductions import candidate_rows, reduce_pattern, reduction_names, shared_keys
from tripleweft.sources.properties import PropertyStore, all_rows, rows_of, version_of
from tripleweft.sources.reductions import read_reduction, recorded_sizes


def mentioned(patterns: Sequence[Pattern]) -> list[str]:
    """All variables of a query in the order of their first mention."""
    return list(dict.fromkeys(name for pattern in patterns for name in variables(pattern)))


def bgp(
    triples: DataFrame | PropertyStore,
    patterns: Sequence[Pattern],
    select: Sequence[str] | None = None,
    allow_product: bool = False,
    inputs: Sequence[DataFrame] | None = None,
) -> DataFrame:
    """Solutions of a conjunctive query as one lazy DataFrame.

    `patterns` is a list of `(s, p, o)` as for `match_pattern`; `select` names
    the variables to keep, all mentioned ones by default. Duplicates are kept.
    `inputs` may give each pattern a table of its own to read.
    """
    node_vars = node_variables(patterns)
    tables = inputs or [
        candidate_rows(triples, q) if is_variable(q[1]) else rows_of(triples, q[1]) for q in patterns
    ]
    waiting = [
        (match_pattern(table, pattern, node_vars), sum(not is_variable(t) for t in pattern))
        for table, pattern in zip(tables, patterns)
    ]
    # Patterns with more constants first: they are the smaller ones. After
    # that, whatever shares a variable with what is joined so far.
    waiting.sort(key=lambda entry: -entry[1])
    joined = waiting.pop(0)[0]
    while waiting:
        names = set(joined.columns)
        linked = [i for i, (b, _) in enumerate(waiting) if names & set(b.columns) or not b.columns]
        following, _ = waiting.pop(linked[0] if linked else 0)
        joined = join_bindings(joined, following, allow_product)
    return project(joined, patterns, select)


def project(
    bindings: DataFrame, patterns: Sequence[Pattern], select: Sequence[str] | None = None
) -> DataFrame:
    """Keep the selected variables, or all mentioned ones in first-mention order."""
    names = mentioned(patterns) if select is None else [name.lstrip("?") for name in select]
    return bindings.select(*names)


def reduced_bgp(
    triples: DataFrame | PropertyStore,
    patterns: Sequence[Pattern],
    select: Sequence[str] | None = None,
    allow_product: bool = False,
    stored: str | None = None,
) -> DataFrame:
    """`bgp` with every pattern reading its reduction; the same solutions.

    Reductions written below the path `stored` are read instead of computed:
    for each pattern the smaller one recorded for the files of `triples`, which
    is not cut any further. If one of them is recorded as empty there are no
    solutions, and nothing is read. Where `triples` has exact filters, they
    stand for the partner columns of patterns without constants.
    """
    known = {}
    if stored is not None:
        spark, version = triples.sparkSession, version_of(triples)
        names = {n for pattern in patterns for n in reduction_names(pattern, patterns).values()}
        sizes = recorded_sizes(spark, stored, names, version)
        if 0 in sizes.values():
            none = spark.createDataFrame([], all_rows(triples).schema)
            return bgp(none, patterns, select, allow_product, [none] * len(patterns))
        known = {name: read_reduction(spark, stored, name, is_encoded(triples), version) for name in sizes}
    live = [q for q in patterns if not known.keys() & set(reduction_names(q, patterns).values())]
    keys = shared_keys(triples, patterns, constants=True) if live else {}
    inputs = [reduce_pattern(triples, pattern, patterns, known, keys) for pattern in patterns]
    return bgp(triples, patterns, select, allow_product, inputs)
