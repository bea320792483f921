"""Stored reductions and the catalog of their sizes."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleweft.functions.terms import is_encoded
from tripleweft.session import broadcast_if_small, write_settings
from tripleweft.sources.properties import PropertyStore, version_of

# Rows with their names are some twenty times as large as they are compressed.
SORT_SHARE = 4  # a partition to be sorted takes so much less than others

CATALOG_SCHEMA = "name STRING, n_rows BIGINT, source STRING"
DATA_SCHEMA = {
    False: "name STRING, s STRING, p STRING, o STRING, run STRING, slot STRING",
    True: "name STRING, s BIGINT, p BIGINT, o STRING, o_id BIGINT, run STRING, slot STRING",
}


def _slot(name: Column, version: str) -> Column:
    # Names grow with the number of partners and may not fit a directory name.
    return F.concat(F.lit("r"), F.sha2(F.concat(F.lit(version), name), 256))


def read_catalog(spark: SparkSession, path: str, version: str = "") -> DataFrame:
    """`name, n_rows` of the reductions stored for a version of the triples.

    Empty before the first write.
    """
    try:
        catalog = spark.read.schema(CATALOG_SCHEMA).parquet(f"{path}/catalog")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        catalog = spark.createDataFrame([], CATALOG_SCHEMA)
    return catalog.where(F.col("source") == version).select("name", "n_rows")


def write_reductions(
    reductions: DataFrame,
    path: str,
    source: DataFrame | PropertyStore | None = None,
    names: DataFrame | None = None,
) -> DataFrame:
    """Store the reductions that are not recorded yet; returns the catalog.

    `source` are the triples they were made from. Records serve queries over
    the same files only: once triples are added, nothing is recorded for them,
    and the next call stores the reductions anew. Without `source` they serve
    queries over triples that have no files.

    Reductions come as one table with their `name`. Their rows are written
    first and recorded afterwards. If a run dies in between, the next one
    finds nothing recorded and overwrites just those partitions, so nothing
    is stored twice. Rows carry the call that wrote them, and only this call's
    are recorded, never what a dead run of another workload left half-written.
    An empty reduction has no rows; those of `names` (column `name`, all that
    were asked for) without a row are recorded with size 0.
    """
    spark, run = reductions.sparkSession, uuid.uuid4().hex
    version = "" if source is None else version_of(source)
    recorded = broadcast_if_small(read_catalog(spark, path, version).select("name"))
    new = reductions.join(recorded, "name", "left_anti")
    # what the name and the call tell is added behind the exchange
    dealt = new.hint("rebalance", F.col("name")).withColumn("slot", _slot(F.col("name"), version))
    with write_settings(spark, SORT_SHARE):
        (
            dealt.sortWithinPartitions("slot", "s")
            .withColumn("run", F.lit(run))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("slot")
            .parquet(f"{path}/data")
        )
    stored = spark.read.schema(DATA_SCHEMA[is_encoded(reductions)]).parquet(f"{path}/data")
    sizes = stored.where(F.col("run") == run).groupBy("name").agg(F.count(F.lit(1)).alias("n_rows"))
    if names is not None:
        asked = names.select("name").distinct().join(recorded, "name", "left_anti")
        sizes = asked.join(sizes, "name", "left").select("name", F.coalesce("n_rows", F.lit(0).cast("bigint")).alias("n_rows"))
    sizes.withColumn("source", F.lit(version)).write.mode("append").parquet(f"{path}/catalog")
    return read_catalog(spark, path, version)


def read_reduction(
    spark: SparkSession, path: str, name: str, encoded: bool = True, version: str = ""
) -> DataFrame:
    """The rows of one stored reduction; only its partition is read."""
    slot = "r" + hashlib.sha256((version + name).encode()).hexdigest()
    reader = spark.read.schema(DATA_SCHEMA[encoded]).option("basePath", f"{path}/data")
    stored = reader.parquet(f"{path}/data/slot={slot}")
    return stored.where(F.col("name") == name).drop("name", "run", "slot")


def recorded_sizes(spark: SparkSession, path: str, names: Iterable[str], version: str = "") -> dict[str, int]:
    """Rows of those of the named reductions that are recorded, the smaller first."""
    recorded = read_catalog(spark, path, version).where(F.col("name").isin(list(names))).orderBy("n_rows", "name")
    return {row["name"]: row["n_rows"] for row in recorded.collect()}  # at most one row for each given name


def read_stored(
    spark: SparkSession, path: str, names: Iterable[str], encoded: bool = True, version: str = ""
) -> dict[str, DataFrame]:
    """Those of the named reductions that are recorded and not empty, as tables by name, the smaller first."""
    sizes = recorded_sizes(spark, path, names, version)
    return {name: read_reduction(spark, path, name, encoded, version) for name, n in sizes.items() if n}
