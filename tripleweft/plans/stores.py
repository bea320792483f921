"""A whole store in one call: dictionary, property tables, statistics, filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleweft.operators.dictionary import build_dictionary, encode_triples
from tripleweft.operators.filters import build_all_filters, write_filters
from tripleweft.operators.stats import property_stats
from tripleweft.session import configure
from tripleweft.sources.properties import PropertyStore, scan_properties, version_of, write_properties


def create_store(
    raw: DataFrame, path: str, kind: str = "exact", fpp: float = 0.01, n_buckets: int | None = None
) -> PropertyStore:
    """Write all that queries over the raw triples need below `path`, and open it.

    Each part is written before the next one reads it, so a lost executor
    never costs more than the part in work. `kind` and `fpp` are the filters',
    `n_buckets` the property tables' (`write_properties`). The filters are tied
    to the files they were made from.
    """
    spark = raw.sparkSession
    build_dictionary(raw).write.mode("overwrite").parquet(f"{path}/dictionary")
    write_properties(encode_triples(raw, spark.read.parquet(f"{path}/dictionary")), f"{path}/triples", n_buckets)
    table = scan_properties(spark, f"{path}/triples")
    property_stats(table).write.mode("overwrite").parquet(f"{path}/stats")
    write_filters(build_all_filters(table, kind, fpp), f"{path}/filters")
    made_from = spark.range(1).select(F.lit(version_of(table)).alias("source"))
    made_from.write.mode("overwrite").parquet(f"{path}/filters-source")
    return open_store(spark, path)


def open_store(spark: SparkSession, path: str) -> PropertyStore:
    """The store written by `create_store`, with `filters`, `stats` and `dictionary`.

    Shuffles are sized by the stored bytes. Filters of other files than are
    there now would lose rows, so `filters` is then None.
    """
    configure(spark, stored_bytes(spark, f"{path}/triples"))
    store = PropertyStore(spark, f"{path}/triples")
    if spark.read.parquet(f"{path}/filters-source").first()["source"] == version_of(store):
        store.filters = spark.read.parquet(f"{path}/filters")
    store.stats = spark.read.parquet(f"{path}/stats")
    store.dictionary = spark.read.parquet(f"{path}/dictionary")
    return store


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below `path`, from their listing; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
