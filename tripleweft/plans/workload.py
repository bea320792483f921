"""Reports over a workload of queries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleweft.functions.terms import is_variable, position_key
from tripleweft.operators.patterns import Pattern, variables
from tripleweft.operators.reductions import for_each_property, reduced_counts, reduction_keys, workload_reductions
from tripleweft.session import broadcast_if_small, materialize
from tripleweft.sources.properties import PropertyStore, all_rows, version_of
from tripleweft.sources.reductions import read_catalog, write_reductions


def pattern_table(spark: SparkSession, queries: Mapping[str, Sequence[Pattern]]) -> DataFrame:
    """The patterns of named queries as a table `query_id, pattern_id, s, p, o`."""
    rows = [
        (query_id, i, *[None if term is None else str(term) for term in pattern])
        for query_id, patterns in queries.items()
        for i, pattern in enumerate(patterns)
    ]
    return spark.createDataFrame(
        rows, "query_id STRING, pattern_id INT, s STRING, p STRING, o STRING"
    )


def write_workload(triples: DataFrame | PropertyStore, patterns: DataFrame, path: str) -> DataFrame:
    """Compute and store the reductions of a workload that are not recorded yet; returns the catalog.

    What is recorded for these triples is taken out first, so a workload that
    has grown by a query costs the reading of that query's columns. Empty
    reductions are recorded too.
    """
    spark, version = triples.sparkSession, version_of(triples)
    recorded = read_catalog(spark, path, version).select("name")
    names = reduction_keys(patterns, all_rows(triples).select("p").distinct()).select("name").distinct()
    new = materialize(names.join(recorded, "name", "left_anti"), "names")
    if new.isEmpty():
        return read_catalog(spark, path, version)
    return write_reductions(workload_reductions(triples, patterns, recorded), path, triples, new)


def workload_report(triples: DataFrame | PropertyStore, queries: Mapping[str, Sequence[Pattern]]) -> DataFrame:
    """Per query: results, input rows before and after reduction, and its shape.

    `query_id, n_results, original_rows, reduced_rows, max_joins, n_patterns`.
    `max_joins` is the largest number of patterns on one variable, predicates
    aside. All queries are worked on together: the plan grows with the longest
    query, not with their number.
    """
    patterns = materialize(pattern_table(triples.sparkSession, queries), "patterns")
    reads = materialize(properties_read(triples, patterns), "reads")
    sizes = all_rows(triples).groupBy(F.col("p").cast("string").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    original = reads.join(sizes, "p").groupBy("query_id").agg(F.sum("n").alias("original_rows"))
    reduced = reduced_counts(triples, patterns, reads).groupBy("query_id").agg(F.sum("n").alias("reduced_rows"))
    totals = pattern_shapes(patterns)
    for part in (count_solutions(triples, queries), original, reduced):
        totals = totals.join(part, "query_id", "left")
    measures = ["n_results", "original_rows", "reduced_rows"]
    return totals.na.fill(0, measures).select("query_id", *measures, "max_joins", "n_patterns")


def _is_variable(name: str) -> Column:
    return F.startswith(F.col(name), F.lit("?"))


def properties_read(triples: DataFrame | PropertyStore, patterns: DataFrame) -> DataFrame:
    """`query_id, pattern_id, p` (as text): the properties each pattern reads.

    A pattern with a variable predicate reads those that have a triple with all
    its constant nodes, or all properties if it has none.
    """
    key = ["query_id", "pattern_id"]
    table = all_rows(triples)
    nodes = table.select(F.col("p").cast("string").alias("p"), *[position_key(table, c).cast("string").alias(c) for c in "so"])
    constants = [F.when(~_is_variable(c) & ~F.startswith(F.col(c), F.lit('"')), F.col(c)).alias(f"{c}_is") for c in "so"]
    unbound = patterns.where(_is_variable("p")).select(*key, *constants)
    by_subject = nodes.join(broadcast_if_small(unbound.where("s_is IS NOT NULL")), F.expr("s = s_is AND (o_is IS NULL OR o = o_is)"))
    by_object = nodes.join(broadcast_if_small(unbound.where("s_is IS NULL AND o_is IS NOT NULL")), F.expr("o = o_is"))
    free = for_each_property(unbound.where("s_is IS NULL AND o_is IS NULL").select(*key), table.select("p").distinct())
    found = by_subject.select(*key, "p").unionByName(by_object.select(*key, "p")).distinct()
    return patterns.where(~_is_variable("p")).select(*key, "p").unionByName(found).unionByName(free)


def join_order(patterns: Sequence[Pattern], allow_product: bool = False) -> list[Pattern]:
    """The patterns with more constants first, then whatever shares a variable with those before."""
    waiting = sorted(patterns, key=lambda q: -sum(not is_variable(t) for t in q))
    order = [waiting.pop(0)]
    while waiting:
        names = {name for q in order for name in variables(q)}
        linked = [q for q in waiting if names & set(variables(q)) or not variables(q)]
        if not linked and names and not allow_product:
            raise ValueError(f"{waiting[0]} shares no variable with the patterns before")
        order.append(linked[0] if linked else waiting[0])
        waiting.remove(order[-1])
    return order


def _steps(queries: Mapping[str, Sequence[Pattern]], allow_product: bool) -> list[list[tuple]]:
    """For each step the pattern that every query joins then, with its places among the query's bindings."""
    steps: list[list[tuple]] = []
    for query_id, patterns in queries.items():
        place: dict[str, int] = {}
        for number, pattern in enumerate(join_order(patterns, allow_product)):
            constant = [None if is_variable(t) else str(t) for t in pattern]
            bound = [place.get(t) if is_variable(t) else None for t in pattern]
            fresh = []
            for i, t in enumerate(pattern):
                fresh.append(is_variable(t) and t not in place)
                if fresh[-1]:
                    place[t] = len(place)
            same = [is_variable(pattern[i]) and pattern[i] == pattern[j] for i, j in ((0, 1), (0, 2), (1, 2))]
            while len(steps) <= number:
                steps.append([])
            steps[number].append((query_id, *constant, *bound, *fresh, *same))
    return steps


_STEP_SCHEMA = (
    "query_id STRING, s_is STRING, p_is STRING, o_is STRING, s_at INT, p_at INT, o_at INT, "
    "s_new BOOLEAN, p_new BOOLEAN, o_new BOOLEAN, same_sp BOOLEAN, same_so BOOLEAN, same_po BOOLEAN"
)
_HOLDS = (
    "(s_is IS NULL OR s = s_is) AND (p_is IS NULL OR p = p_is) AND (o_is IS NULL OR o = o_is) "
    "AND (NOT same_sp OR s = p) AND (NOT same_so OR s = o) AND (NOT same_po OR p = o)"
)


def count_solutions(
    triples: DataFrame | PropertyStore, queries: Mapping[str, Sequence[Pattern]], allow_product: bool = False
) -> DataFrame:
    """`query_id, n_results` of all queries that have solutions, evaluated together.

    Step by step every query joins its next pattern: one table holds the
    bindings of all queries, as lists of values, and one the triples that match
    the patterns of the step; they meet on the query and the values of the
    variables bound before. Each step is written, so the plan does not grow.
    """
    spark, table = triples.sparkSession, all_rows(triples)
    rows = table.select(F.col("s").cast("string").alias("s"), F.col("p").cast("string").alias("p"), "o")

    def listed(*values: Column) -> Column:
        return F.filter(F.array(*values), lambda x: x.isNotNull())

    bindings = None
    for step in _steps(queries, allow_product):
        now = materialize(spark.createDataFrame(step, _STEP_SCHEMA), "step")
        by_name = {"p": "p_is IS NOT NULL", "s": "p_is IS NULL AND s_is IS NOT NULL", "o": "p_is IS NULL AND s_is IS NULL AND o_is IS NOT NULL"}
        matched = [rows.join(broadcast_if_small(now.where(which)), F.col(c) == F.col(f"{c}_is")) for c, which in by_name.items()]
        free = now.where("p_is IS NULL AND s_is IS NULL AND o_is IS NULL")
        matched.append(for_each_property(free, rows).select(*matched[0].columns))
        found = reduce(DataFrame.unionByName, matched).where(_HOLDS).select(
            "query_id",
            listed(*[F.when(F.col(f"{c}_at").isNotNull(), F.col(c)) for c in "spo"]).alias("key"),
            listed(*[F.when(F.col(f"{c}_new"), F.col(c)) for c in "spo"]).alias("fresh"),
        )
        if bindings is None:
            bindings = materialize(found.select("query_id", F.col("fresh").alias("held")), "bindings")
            continue
        places = broadcast_if_small(now.select("query_id", *[f"{c}_at" for c in "spo"]))
        live = bindings.join(places, "query_id")
        live = live.select("query_id", "held", listed(*[F.get("held", F.col(f"{c}_at")) for c in "spo"]).alias("key"))
        joined = live.join(found, ["query_id", "key"]).select("query_id", F.concat("held", "fresh").alias("held"))
        done = bindings.join(now.select("query_id"), "query_id", "left_anti")
        bindings = materialize(joined.unionByName(done), "bindings")
    if bindings is None:
        return spark.createDataFrame([], "query_id STRING, n_results BIGINT")
    return bindings.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_results"))


def pattern_shapes(patterns: DataFrame) -> DataFrame:
    """`query_id, max_joins, n_patterns` of a table of patterns."""
    variable = F.explode(F.array_distinct(F.array("s", "o")))
    per_variable = (
        patterns.select("query_id", "s", "p", "o", variable.alias("var"))
        .where(F.startswith("var", F.lit("?")))
        .distinct()
        .groupBy("query_id", "var")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    joins = per_variable.groupBy("query_id").agg(F.max("n").alias("max_joins"))
    sizes = patterns.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_patterns"))
    return sizes.join(joins, "query_id", "left").select(
        "query_id", F.coalesce("max_joins", F.lit(0)).alias("max_joins"), "n_patterns"
    )
