"""Semi-join reductions: properties cut to the rows that can join.

A reduction keeps the rows of a property whose subject or object also occurs
in the partner columns of a query. It never changes the answer of the query it
is made for, and is named after its own column and its partners, so that
queries of one shape can share it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleweft.functions.terms import (
    is_encoded,
    is_resource,
    is_variable,
    position_equals,
    position_key,
)
from tripleweft.functions.bits import WORD_BITS, exact_bucket, exact_mask, holds
from tripleweft.operators.filters import (
    build_exact_filter,
    candidate_properties,
    common_filter,
    is_bloom,
    keep_held,
    verify_properties,
)
from tripleweft.operators.joins import semi_join, semi_join_or_null
from tripleweft.operators.patterns import Pattern
from tripleweft.session import broadcast_if_small, is_small, materialize
from tripleweft.sources.properties import PropertyStore, all_rows, only_properties, rows_of

# How the columns of a reduction are named.
ANY = "ANY"
TAG = {"s": "_TRPS", "o": "_TRPO"}
JOIN = "_JOIN_"

_EXPANSION_PARTS = 16
MAX_WORDS = 16  # of 64 columns each, by which a node's columns are gathered as bits
FEW_NODES = 1_000_000  # and BROADCAST_BYTES, of the columns whose surviving nodes are broadcast

OWN = object()  # partner property: the one the row itself belongs to


def partner_keys(
    triples: DataFrame | PropertyStore, partner: tuple, constants: Sequence[tuple] = ()
) -> DataFrame:
    """Nodes in one column of one property, or of all for the property ANY.

    `constants` are pairs of a position and the term the rows have there.
    """
    p, position = partner
    rows = all_rows(triples) if p == ANY else rows_of(triples, p)
    for held, term in constants:
        rows = rows.where(position_equals(rows, held, term))
    return rows.select(position_key(rows, position).alias("key")).where("key IS NOT NULL")


def reduce_subject(prop: DataFrame, partners: Sequence[DataFrame]) -> DataFrame:
    """Rows whose subject occurs in every partner, a list of key columns."""
    return _reduce(prop, "s", _common_keys(partners)) if partners else prop


def reduce_object(prop: DataFrame, partners: Sequence[DataFrame]) -> DataFrame:
    """Rows whose object occurs in every partner; literal objects pass."""
    return _reduce(prop, "o", _common_keys(partners)) if partners else prop


def _reduce(
    rows: DataFrame, position: str, keys: DataFrame, node: Callable[[Column], Column] = lambda c: c
) -> DataFrame:
    """Rows whose node at `position` is in `keys`; literals pass.

    `keys` has a column `key`, or is an exact filter. The rows are read once.
    """
    key = node(position_key(rows, position))
    residual = None
    if "bits" in keys.columns:
        keys = keys.select(F.col("bucket").alias("key"), F.col("bits").alias("_bits"))
        key, residual = exact_bucket(key), holds(F.col("_bits"), exact_mask(key))
    join = semi_join if position == "s" else semi_join_or_null
    return join(rows, key, keys, residual)


def _common_keys(partners: Sequence[DataFrame]) -> DataFrame:
    # The key sets are intersected first: they are distinct, so they have no
    # hot keys, and share one partitioning. The big side is then joined once.
    sets = [keys.toDF("key") for keys in partners]
    if len(sets) == 1:
        return sets[0]
    sets = [keys.distinct() for keys in sets]
    return reduce(lambda a, b: a.join(b, "key", "left_semi"), sets)


def find_partners(pattern: Pattern, patterns: Sequence[Pattern]) -> dict[str, list[tuple]]:
    """Partner columns of a pattern's subject and object within a query.

    Every pattern using the variable gives one column: its subject if the
    variable is there, else its object. A variable predicate of another
    pattern stands for all properties; the pattern's own stands for the
    property being read.
    """
    own_p = OWN if is_variable(pattern[1]) else pattern[1]
    found = {}
    for position, term in (("s", pattern[0]), ("o", pattern[2])):
        if not is_variable(term):
            continue
        columns = []
        for other in dict.fromkeys([pattern, *patterns]):
            if term not in (other[0], other[2]):
                continue
            p = ANY if is_variable(other[1]) else other[1]
            columns.append((own_p if other == pattern else p, "s" if other[0] == term else "o"))
        partners = [c for c in dict.fromkeys(columns) if c != (own_p, position)]
        if partners:
            found[position] = partners
    return found


def reduction_names(pattern: Pattern, patterns: Sequence[Pattern]) -> dict[str, str]:
    """Names of the reductions of a pattern with a constant predicate, by column."""
    if is_variable(pattern[1]):
        return {}
    return {
        position: JOIN.join(
            [f"{pattern[1]}{TAG[position]}", *sorted(f"{p}{TAG[c]}" for p, c in partners)]
        )
        for position, partners in find_partners(pattern, patterns).items()
    }


def read_pattern(triples: DataFrame | PropertyStore, pattern: Pattern) -> DataFrame:
    """All rows of the property of a pattern.

    With a variable predicate, the rows of every property that can match:
    those with a triple that has the pattern's constant nodes. A store's
    filters name the properties to verify, all are verified without them.
    """
    if not is_variable(pattern[1]):
        return rows_of(triples, pattern[1])
    nodes = _constant_nodes(pattern)
    if not nodes:
        return all_rows(triples)
    filters = getattr(triples, "filters", None)
    candidates = None if filters is None else candidate_properties(filters, **nodes)
    return only_properties(triples, verify_properties(triples, candidates, **nodes))


def candidate_rows(triples: DataFrame | PropertyStore, pattern: Pattern) -> DataFrame:
    """The rows of the properties that a store's filters leave for a variable predicate.

    Without filters, or constant nodes to look up, those of all properties.
    """
    nodes, filters = _constant_nodes(pattern), getattr(triples, "filters", None)
    if filters is None or not nodes:
        return all_rows(triples)
    return only_properties(triples, candidate_properties(filters, **nodes))


def _constant_nodes(pattern: Pattern) -> dict:
    return {name: t for name, t in (("s", pattern[0]), ("o", pattern[2])) if is_resource(t)}


def reduce_pattern(
    triples: DataFrame | PropertyStore,
    pattern: Pattern,
    patterns: Sequence[Pattern],
    stored: Mapping[str, DataFrame] | None = None,
    shared: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """The rows a pattern reads, cut by all its partners in the query.

    `stored` holds reductions that exist already, by name, the smaller ones
    first: the first that fits is read in place of the property and not cut
    again. `shared` holds the key sets made by `shared_keys`, for reducing all
    patterns of a query. Where the source has exact filters these stand for the
    partner columns, which are then not read.
    """
    fitting = set(reduction_names(pattern, patterns).values()) if stored else set()
    for name, rows in (stored or {}).items():
        if name in fitting:
            return rows
    rows = read_pattern(triples, pattern)
    filters = exact_filters(triples)
    for position, columns in find_partners(pattern, patterns).items():
        of_others = [c for c in columns if c[0] is not OWN]
        if of_others:
            name = pattern["spo".index(position)]
            if shared is not None and "bits" in shared[name].columns:
                rows = keep_held(rows, position_key(rows, position), shared[name], nulls=position == "o")
            elif shared is not None:
                rows = _reduce(rows, position, shared[name])
            elif filters is not None:
                rows = _reduce(rows, position, common_filter(filters, [_filter_column(c) for c in of_others]))
            else:
                rows = _reduce(rows, position, _common_keys([partner_keys(triples, c) for c in of_others]))
        for _, other in (c for c in columns if c[0] is OWN):
            rows = _reduce_within_property(rows, triples, position, other)
    return rows


def shared_keys(
    triples: DataFrame | PropertyStore, patterns: Sequence[Pattern], constants: bool = False
) -> dict[str, DataFrame]:
    """Per variable, the nodes found in every column the query has it in.

    A pattern's own column is among them, which changes nothing for its rows.
    All patterns of a variable then join one and the same set, so Spark
    computes it once and reuses its exchange. With `constants`, a pattern's
    column has only the rows with the pattern's constants: smaller sets that
    serve just this query, as stored reductions must not.

    Sets of ids are exact filters, a bit per id where they are dense, so that
    most can be broadcast and the patterns' rows stay where they are. Those
    that reduce a pattern are written. A source's own exact filters give the
    words of all columns without constants; only other columns are read.
    """
    filters = exact_filters(triples)
    columns: dict[str, dict[tuple, None]] = {}
    for s, p, o in patterns:
        prop = ANY if is_variable(p) else p
        held = tuple((c, t) for c, t in (("s", s), ("o", o)) if constants and not is_variable(t))
        for term in dict.fromkeys((s, o)):
            if is_variable(term):
                columns.setdefault(term, {})[((prop, "s" if term == s else "o"), held)] = None
    if is_encoded(triples):
        used = {
            pattern["spo".index(position)]
            for pattern in patterns
            for position, partners in find_partners(pattern, patterns).items()
            if any(p is not OWN for p, _ in partners)
        }
        sets = {name: _shared_filter(triples, filters, list(found)) for name, found in columns.items()}
        return {name: materialize(words, "key-words") if name in used else words for name, words in sets.items()}
    return {
        name: _common_keys([partner_keys(triples, *c) for c in found])
        for name, found in columns.items()
    }


def exact_filters(triples: DataFrame | PropertyStore) -> DataFrame | None:
    """The exact filters of all properties that a source was given, if any."""
    filters = getattr(triples, "filters", None)
    return None if filters is None or is_bloom(filters) else filters


def _filter_column(column: tuple) -> tuple:
    p, side = column
    return (None if p == ANY else int(p)), side


def _shared_filter(
    triples: DataFrame | PropertyStore, filters: DataFrame | None, found: list[tuple]
) -> DataFrame:
    """Filter of the nodes in all columns; `found` has pairs of a column and its constants."""
    known = [] if filters is None else [column for column, held in found if not held]
    parts = [common_filter(filters, [_filter_column(column) for column in known])] if known else []
    rest = [c for c in found if c[1] or filters is None]
    parts += [build_exact_filter(partner_keys(triples, *c)) for c in rest]
    words = [part.toDF("bucket", f"_{i}") for i, part in enumerate(parts)]
    bits = reduce(Column.bitwiseAND, [F.col(f"_{i}") for i in range(len(parts))])
    joined = reduce(lambda a, b: a.join(b, "bucket"), words)
    return joined.select("bucket", bits.alias("bits")).where("bits <> 0")


def _reduce_within_property(
    rows: DataFrame, triples: DataFrame, position: str, other: str
) -> DataFrame:
    """Rows whose node occurs in the `other` column of their own property."""
    filters = exact_filters(triples)
    if filters is not None:
        words = filters.where(F.col("col") == other)
        words = words.select(F.struct("p", F.col("bucket").alias("node")).alias("key"), F.col("bits").alias("_bits"))
        key = position_key(rows, position)
        bucket = F.when(key.isNotNull(), F.struct(F.col("p"), exact_bucket(key).alias("node")))
        join = semi_join if position == "s" else semi_join_or_null
        return join(rows, bucket, words, holds(F.col("_bits"), exact_mask(key)))
    keys = (
        all_rows(triples)
        .select(F.struct("p", position_key(triples, other).alias("node")).alias("key"))
        .where("key.node IS NOT NULL")
    )
    return _reduce(
        rows, position, keys,
        lambda node: F.when(node.isNotNull(), F.struct(F.col("p"), node.alias("node"))),
    )


def reduction_keys(patterns: DataFrame, properties: DataFrame | None = None) -> DataFrame:
    """Name the reductions of a workload: `query_id, pattern_id, col, name`.

    `patterns` is a table `query_id, pattern_id, s, p, o`. A name is the own
    property and column followed by its distinct partners in sorted order. A
    pattern with a variable predicate is named once for each property in
    `properties` (column `p`), or once as ANY without that list.
    """
    return _expand(_occurrences(patterns), properties).select(
        "query_id", "pattern_id", "col", _name().alias("name")
    )


def _name() -> Column:
    return F.concat_ws(JOIN, F.col("own"), F.col("partners"))


def _occurrences(patterns: DataFrame) -> DataFrame:
    """Each pattern's columns with a variable, and the tags of other columns.

    `query_id, pattern_id, col, p, unbound, first, tags`: `first` is the side
    the pattern itself counts for, and p is ANY if it is a variable.
    """

    def is_var(name: str) -> Column:
        return F.startswith(F.col(name), F.lit("?"))

    def tag(p: Column, position: str) -> Column:
        return F.concat(p, F.lit(TAG[position]))

    prop = F.when(is_var("p"), F.lit(ANY)).otherwise(F.col("p"))
    text = F.struct("s", "p", "o")
    source = patterns.select("query_id", "pattern_id", *[F.col(c).cast("string") for c in "spo"])
    # What each pattern says about each of its variables, one row per variable.
    spoken = source.select(
        "query_id",
        text.alias("text"),
        is_var("p").alias("unbound"),
        F.inline(
            F.array(
                F.struct(
                    F.when(is_var("s"), F.col("s")).alias("var"),
                    F.lit("s").alias("side"),
                    tag(prop, "s").alias("tag"),
                ),
                F.struct(
                    F.when(is_var("o") & ~F.col("o").eqNullSafe(F.col("s")), F.col("o")).alias("var"),
                    F.lit("o").alias("side"),
                    tag(prop, "o").alias("tag"),
                ),
            )
        ),
    ).where("var IS NOT NULL")
    # Tags per variable of a query. Repeats of one pattern count once; the
    # number of unbound patterns behind ANY tells whether another one is there.
    per_variable = (
        spoken.distinct()
        .groupBy("query_id", "var")
        .agg(
            F.collect_set(F.when(~F.col("unbound"), F.col("tag"))).alias("tags"),
            F.count_if(F.col("unbound") & (F.col("side") == "s")).alias("any_s"),
            F.count_if(F.col("unbound") & (F.col("side") == "o")).alias("any_o"),
        )
    )
    own = source.select(
        "query_id",
        "pattern_id",
        "p",
        is_var("p").alias("unbound"),
        (F.col("s") == F.col("o")).alias("loop"),
        F.inline(
            F.array(
                *[
                    F.struct(F.when(is_var(c), F.col(c)).alias("var"), F.lit(c).alias("col"))
                    for c in "so"
                ]
            )
        ),
    ).where("var IS NOT NULL")
    own = own.join(per_variable, ["query_id", "var"])

    # ANY is another pattern's if more unbound patterns count than this one.
    first = F.when(F.col("loop"), F.lit("s")).otherwise(F.col("col"))
    of_any = [
        F.when(
            F.col(f"any_{c}") > F.when(F.col("unbound") & (first == c), 1).otherwise(0),
            F.lit(ANY + TAG[c]),
        )
        for c in "so"
    ]
    return own.select(
        "query_id",
        "pattern_id",
        "col",
        F.when(F.col("unbound"), F.lit(ANY)).otherwise(F.col("p")).alias("p"),
        "unbound",
        first.alias("first"),
        F.array_sort(F.array_union("tags", F.array_compact(F.array(*of_any)))).alias("tags"),
    )


def _expand(occurrences: DataFrame, properties: DataFrame | None) -> DataFrame:
    """Adds `own, partners`, the tags that make up a name.

    An unbound pattern speaks for the property it reads, and is repeated for
    each of `properties`.
    """
    if properties is not None:
        expanded = for_each_property(occurrences.where("unbound").drop("p"), properties)
        occurrences = occurrences.where("NOT unbound").unionByName(expanded)

    def tag(side: str) -> Column:
        return F.concat("p", F.when(F.col(side) == "s", TAG["s"]).otherwise(TAG["o"]))

    mine = F.when(F.col("unbound"), F.array(tag("first"))).otherwise(F.array().cast("array<string>"))
    partners = F.array_except(F.array_union("tags", mine), F.array(tag("col")))
    return (
        occurrences.withColumn("own", tag("col"))
        .withColumn("partners", F.array_sort(partners))
        .where(F.size("partners") > 0)
    )


def for_each_property(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """Each row of `asked`, patterns that read every property, with each of `rows` (column `p`, as text).

    A join on a number: `rows` are dealt to parts, and what is asked goes to
    every part, so that neither side meets in one task.
    """
    dealt = rows.withColumn("p", F.col("p").cast("string"))
    dealt = dealt.distinct() if rows.columns == ["p"] else dealt
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64(*rows.columns), F.lit(_EXPANSION_PARTS)))
    parts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(_EXPANSION_PARTS - 1).cast("bigint")))
    return asked.withColumn("part", parts).join(dealt, "part").drop("part")


def workload_reductions(
    triples: DataFrame | PropertyStore, patterns: DataFrame, recorded: DataFrame | None = None
) -> DataFrame:
    """Every distinct reduction of a workload, computed once: `name` + triples.

    Reductions named in `recorded` (column `name`) are left out before anything
    is read for them. The number of jobs and shuffles does not depend on how
    many reductions there are. The columns a node occurs in are gathered per
    node; a node survives a reduction if they include all partners; the rows of
    the surviving nodes are the reduction. Columns and reductions are numbered,
    so that what is shuffled per node and row is numbers, not names. Where the
    source has exact filters their words are gathered in place of the nodes,
    and only the rows of the reduced columns are read.
    """
    table = all_rows(triples)
    p_type = table.schema["p"].dataType
    shapes = _occurrences(patterns).drop("query_id", "pattern_id").distinct()
    wanted, columns = _numbered(_expand(shapes, table.select("p").distinct()), p_type, recorded)

    own_columns = columns.join(wanted.select(F.col("own").alias("column")), "column", "left_semi")
    filters = exact_filters(triples)
    if filters is None:
        kept = _kept_rows(triples, wanted, columns, own_columns)
    else:
        words = _surviving_words(filters, wanted, columns)
        named = _by_column(triples, own_columns, "inner").where("key IS NOT NULL").withColumn("bucket", exact_bucket(F.col("key")))
        kept = named.join(words, ["column", "bucket"]).where(holds(F.col("bits"), exact_mask(F.col("key"))))
    # literals cannot be partners and pass every reduction of their column
    literals = _by_column(triples, own_columns.where("side = 'o'"), "inner").where("key IS NULL").join(
        broadcast_if_small(wanted.select("reduction", F.col("own").alias("column"))), "column"
    )
    found = kept.select("reduction", *table.columns).unionByName(
        literals.select("reduction", *table.columns)
    )
    return found.join(broadcast_if_small(wanted.select("reduction", "name")), "reduction").select(
        "name", *table.columns
    )


def _kept_rows(
    triples: DataFrame | PropertyStore, wanted: DataFrame, columns: DataFrame, own_columns: DataFrame
) -> DataFrame:
    """`reduction` + triples: the rows whose node all partners of a reduction hold.

    A row needs the words of its node, not the node's reductions, which are
    looked up afterwards; columns without a surviving node are not read. Rows of
    the columns with the fewest such nodes meet them by a broadcast. The others are
    shuffled once by their node, without their property, which the column tells,
    and written, however often the result is used. Where the sets that survive are
    too many to broadcast, rows are joined with the nodes of each reduction.
    """
    n = max(columns.count(), 1)
    held, sets = (None, None) if n > WORD_BITS * MAX_WORDS else _held_sets(triples, wanted, columns, n)
    if sets is None or not is_small(sets):
        survivors = _survivors(triples, wanted, columns, (held, sets))
        return _by_column(triples, own_columns, "inner").where("key IS NOT NULL").join(survivors, ["column", "key"])
    words = [c for c in held.columns if c != "key"]
    of_column = sets.select("column", *words, "nodes").distinct()
    sizes = of_column.groupBy("column").agg(F.sum("nodes").alias("n")).orderBy("n", "column").collect()  # one of a column
    running = list(accumulate(row["n"] for row in sizes))
    few = [row["column"] for row, total in zip(sizes, running) if total <= FEW_NODES]
    nodes = held.join(F.broadcast(of_column.where(F.col("column").isin(few))), words).select("column", "key", *words)
    if not is_small(nodes, FEW_NODES):
        few = []
    parts = []
    if few:
        rows = _by_column(triples, own_columns.where(F.col("column").isin(few)), "inner").where("key IS NOT NULL")
        parts.append(rows.join(F.broadcast(nodes), ["column", "key"]).drop("key", "of_s"))
    many = [row["column"] for row in sizes if row["column"] not in few]
    if many or not few:
        rows = _by_column(triples, own_columns.where(F.col("column").isin(many)), "inner").where("key IS NOT NULL").drop("key", "p")
        of_many = F.broadcast(of_column.where(F.col("column").isin(many)))
        nodes = held.join(of_many.select(*words).distinct(), words, "left_semi")
        node = F.when(F.col("of_s"), position_key(rows, "s")).otherwise(position_key(rows, "o"))
        found = rows.join(nodes, node == F.col("key")).join(of_many, ["column", *words], "left_semi")
        found = materialize(found.drop("key", "of_s"), "kept-rows")
        parts.append(found.join(broadcast_if_small(columns.select("column", "p")), "column"))
    found = reduce(DataFrame.unionByName, parts)
    return found.join(F.broadcast(sets.select("reduction", "column", *words)), ["column", *words])


def _held_sets(
    triples: DataFrame | PropertyStore, wanted: DataFrame, columns: DataFrame, n: int
) -> tuple[DataFrame, DataFrame]:
    """Nodes with the columns they occur in, and the sets of columns that survive, both written.

    `key` and words, 64 of the `n` columns in each, and `reduction, column`, words,
    `nodes` for each set and each reduction whose partners are all in it: the
    columns of a node are gathered by an aggregate of numbers, which combines on
    the map side without lists and sorts, and nodes share few sets of columns.
    """
    number = F.col("column")
    words = [f"_{i}" for i in range(-(-n // WORD_BITS))]
    marks = [F.bit_or(F.when(exact_bucket(number) == i, exact_mask(number)).otherwise(0)).alias(w) for i, w in enumerate(words)]
    held = materialize(_mentions(triples, columns).groupBy("key").agg(*marks), "held-columns")

    def is_held(c: Column) -> Column:
        return holds(F.element_at(F.array(*words), (exact_bucket(c) + 1).cast("int")), exact_mask(c))

    numbers = F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))
    sets = held.groupBy(*words).agg(F.count(F.lit(1)).alias("nodes")).withColumn("columns", F.filter(numbers, is_held))
    surviving = _holding_all(sets, wanted).select("reduction", "column", *words, "nodes")
    return held, materialize(surviving, "surviving-sets")


def _survivors(
    triples: DataFrame | PropertyStore,
    wanted: DataFrame,
    columns: DataFrame,
    written: tuple[DataFrame | None, DataFrame | None] = (None, None),
) -> DataFrame:
    """`reduction, column, key`: the nodes that all partners of a reduction hold.

    Reductions are looked up for the sets of columns and joined back to the nodes;
    `written` are the nodes and sets of `_held_sets`, if they are there. Workloads
    of more than 64 * MAX_WORDS columns gather lists.
    """
    n = max(columns.count(), 1)
    if n > WORD_BITS * MAX_WORDS:
        lists = _mentions(triples, columns).groupBy("key").agg(F.collect_set("column").alias("columns"))
        return _holding_all(lists, wanted).select("reduction", "column", "key")
    held, sets = written if written[0] is not None else _held_sets(triples, wanted, columns, n)
    words = [c for c in held.columns if c != "key"]
    return held.join(broadcast_if_small(sets), words).select("reduction", "column", "key")


def _holding_all(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """Adds `reduction, column` for each reduction whose own column and partners are all in `columns`."""
    return (
        sets.withColumn("own", F.explode("columns"))
        .join(wanted.select("reduction", "own", "partners"), "own")
        .where(F.size(F.array_except("partners", "columns")) == 0)
        .withColumnRenamed("own", "column")
    )


def reduced_counts(triples: DataFrame | PropertyStore, patterns: DataFrame, reads: DataFrame) -> DataFrame:
    """`query_id, pattern_id, n`: rows that each pattern of a workload reads after reduction.

    `reads` are the properties each pattern reads, `query_id, pattern_id, p` as
    text. Every triple meets the pairs of reductions asked of its property
    once and is counted for those whose partners hold its nodes.
    """
    table = all_rows(triples)
    named = _expand(_occurrences(patterns), table.select("p").distinct())
    wanted, columns = _numbered(named, table.schema["p"].dataType, None)
    numbers = wanted.select("reduction", "name")
    named = named.select("query_id", "pattern_id", "p", "col", _name().alias("name")).join(numbers, "name")
    sides = [F.max(F.when(F.col("col") == c, F.col("reduction"))).alias(f"of_{c}") for c in "so"]
    asked = reads.join(named.groupBy("query_id", "pattern_id", "p").agg(*sides), ["query_id", "pattern_id", "p"], "left")
    asked = materialize(asked, "asked")
    pairs = asked.select(F.col("p").alias("of_p"), "of_s", "of_o").distinct()
    rows = table.select(F.col("p").cast("string").alias("p"), *[position_key(table, c).alias(f"key_{c}") for c in "so"])
    found = rows.join(broadcast_if_small(pairs), F.col("p") == F.col("of_p")).drop("of_p")
    filters = exact_filters(triples)
    if filters is None:
        held = _survivors(triples, wanted, columns).select(F.struct("reduction", F.col("key").alias("at")).alias("key"))
    else:
        words = _surviving_words(filters, wanted, columns)
        held = words.select(F.struct("reduction", F.col("bucket").alias("at")).alias("key"), F.col("bits").alias("_bits"))
    held = materialize(held, "survivors")
    for c in "so":
        node = F.col(f"key_{c}")
        at, residual = (node, None) if filters is None else (exact_bucket(node), holds(F.col("_bits"), exact_mask(node)))
        # without a reduction, or for a literal, the row passes
        key = F.when(F.col(f"of_{c}").isNotNull() & node.isNotNull(), F.struct(F.col(f"of_{c}").alias("reduction"), at.alias("at")))
        found = semi_join_or_null(found, key, held, residual)
    counted = found.groupBy("p", "of_s", "of_o").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.select(F.struct("p", "of_s", "of_o").alias("pair"), "n")
    asked = asked.withColumn("pair", F.struct("p", "of_s", "of_o"))
    total = asked.join(counted, asked["pair"].eqNullSafe(counted["pair"])).groupBy("query_id", "pattern_id")
    return total.agg(F.sum("n").alias("n"))


def _surviving_words(filters: DataFrame, wanted: DataFrame, columns: DataFrame) -> DataFrame:
    """`reduction, column, bucket, bits`: the nodes that all partners of a reduction hold."""
    named = columns.where("p IS NOT NULL").select("column", "p", F.col("side").alias("col"))
    of_any = columns.where("is_any").select("column", F.col("side").alias("col"))
    any_words = filters.groupBy("col", "bucket").agg(F.bit_or("bits").alias("bits"))
    held = filters.join(broadcast_if_small(named), ["p", "col"]).select("column", "bucket", "bits")
    held = held.unionByName(any_words.join(broadcast_if_small(of_any), "col").select("column", "bucket", "bits"))
    asked = wanted.select("reduction", "own", F.size("partners").alias("n"), F.explode("partners").alias("column"))
    words = held.join(asked, "column").groupBy("reduction", F.col("own").alias("column"), "n", "bucket")
    words = words.agg(F.count(F.lit(1)).alias("found"), F.bit_and("bits").alias("bits"))
    return words.where("found = n AND bits <> 0").select("reduction", "column", "bucket", "bits")


def _numbered(definitions: DataFrame, p_type, recorded: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Distinct reductions and the columns they name, numbered and written.

    Both tables are as small as the workload's vocabulary: `reduction, name,
    own, partners` and `column, p, side, is_any`. A constant the dictionary
    does not know has no p either, and no rows. Reductions have unique numbers,
    columns dense ones from 0, both fixed by the writing.
    """
    distinct = definitions.select(_name().alias("name"), "own", "partners").distinct()
    if recorded is not None:
        distinct = distinct.join(recorded.select("name"), "name", "left_anti")
    distinct = materialize(
        distinct.withColumn("reduction", F.monotonically_increasing_id()), "workload"
    )
    tag = F.explode(F.array_union(F.array("own"), F.col("partners"))).alias("tag")
    prop = F.regexp_replace("tag", "_TRP[SO]$", "")
    columns = materialize(
        distinct.select(tag)
        .distinct()
        .select(
            (F.row_number().over(Window.orderBy("tag")) - 1).cast("bigint").alias("column"),
            "tag",
            F.when(prop != ANY, prop).try_cast(p_type).alias("p"),
            (prop == ANY).alias("is_any"),
            F.lower(F.right("tag", F.lit(1))).alias("side"),
        ),
        "workload-columns",
    )
    numbers = columns.select("column", "tag")
    wanted = (
        distinct.withColumn("tag", F.explode("partners"))
        .join(numbers, "tag")
        .groupBy("reduction", "name", F.col("own").alias("own_tag"))
        .agg(F.collect_set("column").alias("partners"))
        .join(numbers.select(F.col("column").alias("own"), F.col("tag").alias("own_tag")), "own_tag")
        .select("reduction", "name", "own", "partners")
    )
    return materialize(wanted, "workload"), columns


def _mentions(triples: DataFrame | PropertyStore, columns: DataFrame) -> DataFrame:
    """`column, key`: each node with the numbered columns it occurs in."""
    of_any = {row["side"]: row["column"] for row in columns.where("is_any").collect()}  # s, o
    if not of_any:
        rows = _by_column(triples, columns, "inner")
    else:
        # every triple counts for ANY, whether or not its property is named
        rows = _by_column(triples, columns, "left", of_any)
    return rows.select("column", "key").where("key IS NOT NULL")


def _by_column(
    triples: DataFrame | PropertyStore,
    columns: DataFrame,
    how: str,
    of_any: Mapping[str, int] | None = None,
) -> DataFrame:
    """Each triple once per numbered column it belongs to: `column, key, of_s` + triple."""
    numbers = (
        columns.where("p IS NOT NULL")
        .groupBy("p")
        .agg(*[F.max(F.when(F.col("side") == c, F.col("column"))).alias(f"_{c}") for c in "so"])
    )
    rows = only_properties(triples, numbers) if how == "inner" else all_rows(triples)
    named = [(c, F.col(f"_{c}")) for c in "so"]
    named += [(c, F.lit(number).cast("bigint")) for c, number in (of_any or {}).items()]
    sides = [
        F.struct(number.alias("column"), position_key(rows, c).alias("key"), F.lit(c == "s").alias("of_s"))
        for c, number in named
    ]
    return (
        rows.join(broadcast_if_small(numbers), "p", how)
        .select(*rows.columns, F.inline(F.array(*sides)))
        .where("column IS NOT NULL")
    )
