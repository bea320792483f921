"""Term dictionary: building, extending, encoding and decoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleweft.functions.terms import UNKNOWN_ID, as_id, is_literal, is_resource, object_key
from tripleweft.session import BROADCAST_ROWS, broadcast_if_small, materialize

_ROW_BITS = (1 << 33) - 1  # row number part of monotonically_increasing_id


def build_dictionary(triples: DataFrame) -> DataFrame:
    """`id, term` for every distinct subject, predicate and resource object.

    Ids are 1..N in term order.
    """
    return _number(_resource_terms(triples), F.lit(0))


def extend_dictionary(dictionary: DataFrame, triples: DataFrame) -> DataFrame:
    """The dictionary plus unseen terms, numbered on from its largest id."""
    unseen = _resource_terms(triples).join(dictionary.select("term"), "term", "left_anti")
    last = dictionary.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last")).scalar()
    return dictionary.select("id", "term").unionByName(_number(unseen, last))


def _resource_terms(triples: DataFrame) -> DataFrame:
    nodes = F.array(F.col("s"), F.col("p"), object_key(triples))
    return (
        triples.select(F.explode(nodes).alias("term")).where(F.col("term").isNotNull()).distinct()
    )


def _number(terms: DataFrame, offset: Column) -> DataFrame:
    """Dense ids in term order without a global window.

    The terms are written first, as a range sort reads its input twice, for its
    bounds and for its rows. The sort places them; each row's partition and
    position are written together with it, so that the counts per partition and
    the ids come from one and the same placement even if tasks run again.
    """
    placed = materialize(
        materialize(terms, "distinct-terms").orderBy("term").select(
            "term",
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)).alias("pos"),
        ),
        "terms",
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("part")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    # one row per sort partition, so the number of shuffle partitions bounds it
    return placed.join(F.broadcast(starts), "part").select(
        (F.col("pos") + F.col("start") + offset + 1).cast("bigint").alias("id"), "term"
    )


def encode_triples(triples: DataFrame, dictionary: DataFrame, unknown: str = "fail") -> DataFrame:
    """`s, p, o, o_id` with ids for terms; literals stay text with a null id.

    Predicates are few: their ids are looked up first and written, and Spark
    broadcasts them if that table is small. Subjects come next, while the rows
    of one subject still lie together as in most inputs, so that their text is
    shuffled once and packs well; the shuffle on the object has their ids.
    Literal rows skip it. A subject or predicate the dictionary lacks raises an
    error that names it; with `unknown="drop"` its triples are left out. A
    resource object it lacks stays text.
    """
    if unknown not in ("fail", "drop"):
        raise ValueError(f"unknown is fail or drop, not {unknown!r}")
    how = "left" if unknown == "fail" else "inner"

    def known(number: str, term: str) -> Column:
        missing = F.raise_error(F.concat(F.lit("not in the dictionary: "), F.col(term))).cast("bigint")
        return F.when(F.col(number).isNotNull() | F.col(term).isNull(), F.col(number)).otherwise(missing)

    predicates = materialize(triples.select(F.col("p").alias("term")).distinct(), "predicates")
    predicate_ids = materialize(dictionary.join(predicates, "term", "left_semi"), "predicate-ids")
    rows = triples.join(
        predicate_ids.select(F.col("id").alias("p_id"), F.col("term").alias("p")), "p", how
    ).select("s", known("p_id", "p").alias("p"), "o")

    subjects = dictionary.select(F.col("id").alias("s_id"), F.col("term").alias("s"))

    def with_subjects(some: DataFrame) -> DataFrame:
        return some.join(subjects, "s", how).select(known("s_id", "s").alias("s"), "p", "o")

    literals = with_subjects(rows.where(is_literal("o"))).withColumn("o_id", F.lit(None).cast("bigint"))
    resources = (
        with_subjects(rows.where(~is_literal("o")))
        .join(dictionary.select(F.col("id").alias("o_id"), F.col("term").alias("o")), "o", "left")
        .select("s", "p", F.coalesce(F.col("o_id").cast("string"), F.col("o")).alias("o"), "o_id")
    )
    return literals.unionByName(resources)


def encode_patterns(patterns: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Resolve the constants of a table `query_id, pattern_id, s, p, o`.

    Ids are given as text, variables and literals stay as they are. `matched`
    is false for a pattern with a constant the dictionary does not know, which
    is left as it is. The dictionary is read once, for the distinct constants.
    """
    keys = ["query_id", "pattern_id"]
    cells = patterns.select(
        *keys,
        F.explode(
            F.create_map(
                *[part for position in "spo" for part in (F.lit(position), F.col(position))]
            )
        ).alias("position", "term"),
    )
    is_constant = ~F.startswith("term", F.lit("?")) & ~is_literal("term")
    constants = cells.where(is_constant).select("term").distinct()
    ids = dictionary.join(constants, "term").select("term", "id")
    looked_up = (
        cells.join(ids, "term", "left")
        .withColumn("value", F.coalesce(F.col("id").cast("string"), F.col("term")))
        .withColumn("known", F.col("id").isNotNull() | ~is_constant)
    )
    return looked_up.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("position") == position, F.col("value"))).alias(position)
            for position in "spo"
        ],
        F.bool_and("known").alias("matched"),
    )


def encode_query(patterns: Sequence[tuple], dictionary: DataFrame) -> list[tuple]:
    """The patterns of one query with ids for constants, UNKNOWN_ID if they have none."""
    constants = {t for pattern in patterns for t in pattern if is_resource(t)}
    found = dictionary.where(F.col("term").isin(list(constants))).select("term", "id")
    ids = {row["term"]: row["id"] for row in found.collect()}  # one row per constant at most
    return [
        tuple(ids.get(t, UNKNOWN_ID) if is_resource(t) else t for t in pattern)
        for pattern in patterns
    ]


def decode_bindings(
    bindings: DataFrame, dictionary: DataFrame, variables: Sequence[str] | None = None
) -> DataFrame:
    """Ids back to terms as text; values the dictionary lacks pass through.

    The bindings are computed once and written. Variables of few terms are
    decoded last, by a broadcast of these. For the others the dictionary, which
    may be far larger, is cut to their distinct ids first, unless the bindings
    hold more ids than it has terms. All steps go by true sizes: a small
    result never shuffles the dictionary.
    """
    columns = bindings.columns
    names = list(columns if variables is None else variables)
    bindings = materialize(bindings, "bindings")
    if not names:
        return bindings
    number = [F.approx_count_distinct(as_id(bindings, name)).alias(name) for name in names]
    counted = bindings.agg(F.count(F.lit(1)).alias("_rows"), *number).first().asDict()
    few = [name for name in names if counted[name] <= BROADCAST_ROWS // 2]
    many = [name for name in names if name not in few]

    def terms_of(some: list[str]) -> DataFrame:
        ids = bindings.select(F.explode(F.array(*[as_id(bindings, name) for name in some])).alias("id"))
        ids = materialize(ids.where("id IS NOT NULL").distinct(), "binding-ids")
        return materialize(dictionary.join(ids, "id", "left_semi").select("id", "term"), "terms")

    terms = {name: broadcast_if_small(terms_of([name])) for name in few}
    if many:
        whole = counted["_rows"] * len(many) >= dictionary.count()
        terms |= dict.fromkeys(many, dictionary if whole else terms_of(many))
    # A literal has no id. It is given a negative one, which no term has, made
    # from the whole row, so that literals spread over all partitions instead
    # of meeting in the one for null. A row moves with its id alone: the value
    # itself goes along only where it says more than the id.
    decoded = bindings
    for name in many + few:
        spread = -1 - F.pmod(F.xxhash64(*[F.col(c) for c in columns]), F.lit(1 << 31))
        number, value = as_id(bindings, name), F.col(name).cast("string")
        number = F.when(number >= 0, number)
        found = terms[name].select(F.col("id").alias("_id"), F.col("term").alias("_term"))
        of_id = F.when(F.col("_id") >= 0, F.col("_id").cast("string"))
        decoded = (
            decoded.withColumn("_id", F.coalesce(number, spread))
            .withColumn("_value", F.when(~value.eqNullSafe(number.cast("string")), value))
            .drop(name)
            .join(found, "_id", "left")
            .withColumn(name, F.coalesce(F.col("_term"), F.col("_value"), of_id))
            .drop("_id", "_term", "_value")
        )
    return decoded.select(*columns)


def expand_curies(df: DataFrame, col: str, prefixes: DataFrame) -> DataFrame:
    """`ex:Mary` to a full IRI by the table `prefix, iri`.

    Literals and values without a known prefix stay as they are.
    """
    table = prefixes.groupBy(F.col("prefix").alias("_prefix")).agg(F.max("iri").alias("_iri"))
    local = F.substring(F.col(col), F.instr(F.col(col), ":") + 1, F.length(F.col(col)))
    prefix = F.when(
        F.contains(F.col(col), F.lit(":")) & ~is_literal(col),
        F.split_part(F.col(col), F.lit(":"), F.lit(1)),
    )
    return (
        df.withColumn("_prefix", prefix)
        .join(broadcast_if_small(table), "_prefix", "left")
        .withColumn(col, F.coalesce(F.concat(F.col("_iri"), local), F.col(col)))
        .select(*df.columns)
    )
