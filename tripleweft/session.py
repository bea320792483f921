"""Session settings, written intermediates and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A table is only hinted for broadcast when it has been counted and holds at
# most so many rows and bytes. Beyond it the hint is left out and Spark shuffles.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20

# Stored triples take some ten bytes each and a hundred as rows, so a few MB of
# input are what a task can hold without spilling.
SHUFFLE_BYTES = 4 << 20  # input per shuffle partition, before columns are pruned
MAX_PARTITIONS = 10_000  # of a shuffle, as long as that leaves each at most MAX_SHUFFLE_BYTES
MAX_SHUFFLE_BYTES = 1 << 30
SPLIT_BYTES = 16 << 20  # of stored tables, read by one task
MAX_FILES = 400_000  # aim for fewer files than this in one table

ADVISED = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configure(spark: SparkSession, input_bytes: int | None = None) -> SparkSession:
    """Set the run-time options the joins of this package rely on.

    Star queries join many inputs on one key. By default Spark gives up
    splitting a hot key there because it would cost another exchange; a key
    with a third of all rows is far worse than that exchange.

    `input_bytes`, the size of the triples, raises the number of shuffle
    partitions so that one stays within an executor's memory; adaptive
    execution merges those that turn out small. It also raises the size that
    merged and rebalanced partitions, and so the files written, are given.
    Tables are read in splits that stay small as rows, and a join is made by
    hashing, without sorting its larger side, where adaptive execution has
    seen that every partition of the smaller one is at most of the merged size.
    """
    if input_bytes is not None:
        advised = min(max(input_bytes // MAX_FILES, 64 << 20), 512 << 20)
        spark.conf.set(ADVISED, str(advised))
        spark.conf.set("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", str(min(advised, 64 << 20)))
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(min(max(input_bytes // MAX_FILES, SPLIT_BYTES), 128 << 20)))
        wanted = max(min(-(-input_bytes // SHUFFLE_BYTES), MAX_PARTITIONS), -(-input_bytes // MAX_SHUFFLE_BYTES))
        if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
            spark.conf.set("spark.sql.shuffle.partitions", str(wanted))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark


@contextmanager
def write_settings(spark: SparkSession, share: int = 1) -> Iterator[None]:
    """For a write, whose plan runs once: its shuffle files are removed at its end.

    Else they stay until the driver collects garbage, beside those of later jobs.
    Adaptive execution merges and splits partitions to a `share`-th of its usual
    size meanwhile; it goes by compressed bytes, and rows that repeat long names
    take many times as much to sort.
    """
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(ADVISED))
    values = {SHUFFLE_CLEANUP: "true", ADVISED: str(max(size // share, min(size, 1 << 20)))}
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def scratch_dir(spark: SparkSession) -> str:
    """Folder for written intermediates: the session's checkpoint folder.

    A machine-local folder is used only by a local master without a setting,
    as in tests. On a cluster a missing setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tripleweft-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below `scratch_dir`."""
    return f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared scratch folder and read it back.

    This cuts the lineage, survives lost executors, and gives Catalyst the
    true size of the table, so that it broadcasts it only when it is small.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with write_settings(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of `df` if a count shows it is small, else leave it."""
    return F.broadcast(df) if is_small(df, max_rows) else df


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether a count shows that `df` may be broadcast.

    Columns of text and of lists are counted by their bytes, others as 8.
    """
    wide = [name for name, kind in df.dtypes if kind in ("string", "binary") or "<" in kind]
    size = F.octet_length(F.to_json(F.struct(*wide))) if wide else F.lit(0)
    n_rows, n_bytes = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    n_bytes += 8 * n_rows * (len(df.columns) - len(wide))
    return n_rows <= max_rows and n_bytes <= BROADCAST_BYTES
