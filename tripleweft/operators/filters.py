"""Membership filters as tables.

An exact filter has the columns `bucket, bits`; a Bloom filter also has
`n_buckets, n_probes`, the same in each of its rows. Each key sets and tests
bits of one 64-bit word only, so building is one hash aggregate and probing
one equi-join, whatever the number of probes. Filters are broadcast only after
a count of their words, a large one in pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleweft.functions.bits import (
    WORD_BITS,
    bloom_bucket,
    bloom_mask,
    bloom_shape,
    exact_bucket,
    exact_mask,
    holds,
)
from tripleweft.functions.terms import is_literal_text, object_key, position_equals
from tripleweft.operators.joins import semi_join, semi_join_or_null
from tripleweft.operators.layout import intersect_properties
from tripleweft.session import BROADCAST_BYTES, materialize
from tripleweft.sources.properties import PropertyStore, all_rows, only_properties

WORD_BYTES = 48  # of a filter's row in a broadcast table, its place in the hash table included
MAX_PIECES = 8  # broadcast pieces of one filter
_COUNT_ERROR = 0.05  # relative error of the distinct counts that size Bloom filters
_HEADROOM = 1.0 + 3 * _COUNT_ERROR


def build_exact_filter(ids: DataFrame) -> DataFrame:
    """Exact filter of the ids in the first column of `ids`; nulls are skipped."""
    return _exact_words(_keys(ids), [])


def build_bloom_filter(ids: DataFrame, fpp: float, n_buckets: int | None = None) -> DataFrame:
    """Bloom filter of the ids in the first column of `ids`.

    It is sized by their (estimated) distinct number and the false-positive
    rate, or by `n_buckets`, so that filters to be united can be made alike.
    """
    keys = _keys(ids)
    if n_buckets is None:
        size = keys.agg(_n_buckets(F.col("key"), fpp).alias("n_buckets")).scalar()
    else:
        size = F.lit(n_buckets).cast("bigint")
    return _bloom_words(keys.withColumn("n_buckets", size), [], fpp)


def _keys(ids: DataFrame) -> DataFrame:
    return ids.select(F.col(ids.columns[0]).cast("bigint").alias("key")).where("key IS NOT NULL")


def _n_buckets(key: Column, fpp: float) -> Column:
    bits_per_key, _ = bloom_shape(fpp)
    n_keys = F.approx_count_distinct(key, _COUNT_ERROR) * F.lit(_HEADROOM)
    words = F.ceil(n_keys * F.lit(bits_per_key / WORD_BITS))
    return F.greatest(words, F.lit(1)).cast("bigint")


def _exact_words(keys: DataFrame, by: Sequence[str]) -> DataFrame:
    key = F.col("key")
    return keys.groupBy(*by, exact_bucket(key).alias("bucket")).agg(
        F.bit_or(exact_mask(key)).alias("bits")
    )


def _bloom_words(keys: DataFrame, by: Sequence[str], fpp: float) -> DataFrame:
    _, n_probes = bloom_shape(fpp)
    key, size = F.col("key"), F.col("n_buckets")
    return (
        keys.groupBy(*by, bloom_bucket(key, size).alias("bucket"), "n_buckets")
        .agg(F.bit_or(bloom_mask(key, F.lit(n_probes))).alias("bits"))
        .select(*by, "bucket", "bits", "n_buckets", F.lit(n_probes).alias("n_probes"))
    )


def is_bloom(filters: DataFrame) -> bool:
    return "n_buckets" in filters.columns


def probe_exact(df: DataFrame, col: str, filter: DataFrame) -> DataFrame:
    """Rows of `df` whose id in `col` is in the filter.

    A filter of up to MAX_PIECES * BROADCAST_BYTES bytes, by a count of its
    words, is broadcast in pieces of at most BROADCAST_BYTES, and `df` is not
    moved. A larger one is joined by a shuffle of both.
    """
    words = filter.select(F.col("bucket").alias("key"), F.col("bits").alias("_bits"))
    bucket, mask = exact_bucket(F.col(col)), exact_mask(F.col(col))
    return _probe(df, bucket, materialize(words, "filter"), lambda bits: holds(bits, mask))


def keep_held(rows: DataFrame, key: Column, filter: DataFrame, nulls: bool = False) -> DataFrame:
    """Rows whose `key` is in a written exact filter, which is counted; null ones too with `nulls`.

    Broadcast in pieces or shuffled as by `probe_exact`.
    """
    words = filter.select(F.col("bucket").alias("key"), F.col("bits").alias("_bits"))
    return _probe(rows, exact_bucket(key), words, lambda bits: holds(bits, exact_mask(key)), nulls)


def _probe(
    df: DataFrame, bucket: Column, words: DataFrame, test: Callable[[Column], Column], nulls: bool = False
) -> DataFrame:
    """`words` are written, as they are counted and then read."""
    pieces = max(-(-words.count() * WORD_BYTES // BROADCAST_BYTES), 1)
    if pieces > MAX_PIECES:
        join = semi_join_or_null if nulls else semi_join
        return join(df, bucket, words, test(F.col("_bits")))
    if pieces == 1 and not nulls:
        words = words.withColumnRenamed("key", "_right_key")
        return df.join(F.broadcast(words), (bucket == F.col("_right_key")) & test(F.col("_bits")), "left_semi")
    # a bucket is in one piece only, so at most one of the outer joins finds it
    found = df
    for i in range(pieces):
        piece = words.where(F.pmod(F.xxhash64("key"), F.lit(pieces)) == i).toDF(f"_key{i}", f"_bits{i}")
        found = found.join(F.broadcast(piece), bucket == F.col(f"_key{i}"), "left")
    bits = F.coalesce(*[F.col(f"_bits{i}") for i in range(pieces)])
    kept = test(bits) | bucket.isNull() if nulls else test(bits)
    return found.where(kept).select(*df.columns)


def probe_bloom(df: DataFrame, col: str, filter: DataFrame) -> DataFrame:
    """Rows of `df` whose id in `col` may be in the filter; none is missed.

    Broadcast in pieces or shuffled as by `probe_exact`.
    """
    shape = filter.agg(F.struct(_single("n_buckets"), _single("n_probes")).alias("shape")).scalar()
    words = filter.select(F.col("bucket").alias("key"), F.col("bits").alias("_bits"))
    rows = df.withColumn("_shape", shape)
    bucket = bloom_bucket(F.col(col), F.col("_shape.n_buckets"))
    mask = bloom_mask(F.col(col), F.col("_shape.n_probes"))
    return _probe(rows, bucket, materialize(words, "filter"), lambda bits: holds(bits, mask)).drop("_shape")


def _single(column: str) -> Column:
    mixed = F.raise_error(F.lit(f"the filter mixes different values of {column}"))
    low, high = F.min(column), F.max(column)
    value = F.when(low == high, high).when(low.isNull(), F.lit(1)).otherwise(mixed.cast("bigint"))
    return value.alias(column)


def union_filters(a: DataFrame, b: DataFrame) -> DataFrame:
    """Filter of everything in `a` or `b`, two filters of one kind and size."""
    if set(a.columns) != set(b.columns):
        raise ValueError("only filters of one kind can be united")
    keys = [name for name in a.columns if name != "bits"]
    both = a.unionByName(b).groupBy(*keys).agg(F.bit_or("bits").alias("bits"))
    return both.select(*a.columns)


def build_all_filters(enc: DataFrame, kind: str = "exact", fpp: float = 0.01) -> DataFrame:
    """Subject and object filters of every property of encoded triples.

    `p, col, bucket, bits` and, for `kind="bloom"`, the columns of its size.
    Literal objects are left out. All filters come from one aggregate.
    """
    sides = F.array(
        F.struct(F.lit("s").alias("col"), F.col("s").alias("key")),
        F.struct(F.lit("o").alias("col"), object_key(enc).alias("key")),
    )
    keys = enc.select("p", F.inline(sides)).where("key IS NOT NULL")
    if kind == "exact":
        return _exact_words(keys, ["p", "col"])
    if kind != "bloom":
        raise ValueError(f"kind must be exact or bloom, not {kind}")
    # two rows per property, written so that their true size decides the join
    sizes = materialize(
        keys.groupBy("p", "col").agg(_n_buckets(F.col("key"), fpp).alias("n_buckets")),
        "filter-sizes",
    )
    return _bloom_words(keys.join(sizes, ["p", "col"]), ["p", "col"], fpp)


def common_filter(filters: DataFrame, columns: Sequence[tuple]) -> DataFrame:
    """Exact filter (`bucket, bits`) of the nodes that every one of the `columns` holds.

    `filters` are the exact ones of all properties; a column is a pair of a
    property, or None for all of them, and a side. One aggregate ANDs the words
    of the columns; no triples are read.
    """
    tests = [(F.col("col") == side) & (F.lit(True) if p is None else F.col("p") == F.lit(p)) for p, side in dict.fromkeys(columns)]
    held = [F.bit_or(F.when(test, F.col("bits"))).alias(f"_{i}") for i, test in enumerate(tests)]
    bits = reduce(Column.bitwiseAND, [F.col(f"_{i}") for i in range(len(tests))])  # null where one has no word
    read = filters.where(reduce(Column.__or__, tests))
    return read.groupBy("bucket").agg(*held).select("bucket", bits.alias("bits")).where("bits <> 0")


def write_filters(filters: DataFrame, path: str) -> None:
    """Store the filters of all properties, in the order constants are looked up."""
    (
        filters.repartitionByRange("col", "bucket", "p")
        .sortWithinPartitions("col", "bucket", "p")
        .write.mode("overwrite")
        .parquet(path)
    )


def candidate_properties(filters: DataFrame, s=None, o=None) -> DataFrame:
    """Properties (column `p`) whose filters hold the constants.

    With both given, both must be held. A literal object does not restrict
    the candidates, and without constants every property is one.
    """
    restrictions = []
    if s is not None:
        restrictions.append(_holding(filters, "s", s))
    if o is not None and not is_literal_text(o):
        restrictions.append(_holding(filters, "o", o))
    if not restrictions:
        return filters.select("p").distinct()
    if len(restrictions) == 2:
        return intersect_properties(*restrictions)
    return restrictions[0]


def _holding(filters: DataFrame, side: str, term) -> DataFrame:
    key = F.lit(int(term)).cast("bigint")
    if is_bloom(filters):
        bucket, mask = bloom_bucket(key, F.col("n_buckets")), bloom_mask(key, F.col("n_probes"))
    else:
        bucket, mask = exact_bucket(key), exact_mask(key)
    found = (F.col("col") == side) & (F.col("bucket") == bucket) & holds(F.col("bits"), mask)
    return filters.where(found).select("p").distinct()


def workload_candidates(filters: DataFrame, patterns: DataFrame) -> DataFrame:
    """Candidates of all patterns of a workload with a variable predicate: `query_id, pattern_id, p`.

    `patterns` is an encoded table `query_id, pattern_id, s, p, o`. All constant
    nodes are looked up by one join with the filters, on side and bucket, and a
    bit test; a property is a candidate if it holds every constant of the
    pattern. Patterns without constant nodes have every property as candidate
    and are left out.
    """
    sides = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).try_cast("bigint").alias("key")) for c in "so"])
    unbound = patterns.where(F.startswith("p", F.lit("?"))).select("query_id", "pattern_id", F.inline(sides))
    constants = unbound.where("key IS NOT NULL")
    key = F.col("key")
    if is_bloom(filters):  # the bucket depends on the size of each filter
        shapes = filters.select("p", "col", "n_buckets", "n_probes").distinct()
        asked = constants.join(shapes, "col").withColumn("bucket", bloom_bucket(key, F.col("n_buckets")))
        found = asked.join(filters.select("p", "col", "bucket", "bits"), ["p", "col", "bucket"])
        found = found.where(holds(F.col("bits"), bloom_mask(key, F.col("n_probes"))))
    else:
        asked = constants.withColumn("bucket", exact_bucket(key))
        found = asked.join(filters, ["col", "bucket"]).where(holds(F.col("bits"), exact_mask(key)))
    held = found.groupBy("query_id", "pattern_id", "p").agg(F.count_distinct("col").alias("held"))
    wanted = constants.groupBy("query_id", "pattern_id").agg(F.count_distinct("col").alias("held"))
    return held.join(wanted, ["query_id", "pattern_id", "held"], "left_semi").select("query_id", "pattern_id", "p")


def verify_properties(
    triples: DataFrame | PropertyStore, candidates: DataFrame | None = None, s=None, o=None
) -> DataFrame:
    """Candidates that have a triple with the constants, by reading them."""
    if candidates is None:
        triples = all_rows(triples)
    else:
        triples = only_properties(triples, candidates)
    if s is not None:
        triples = triples.where(position_equals(triples, "s", s))
    if o is not None:
        triples = triples.where(position_equals(triples, "o", o))
    return triples.select("p").distinct()
