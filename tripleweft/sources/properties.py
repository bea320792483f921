"""Property tables: one Parquet partition per predicate."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleweft.functions.terms import is_encoded, position_equals
from tripleweft.session import broadcast_if_small, write_settings

MAX_LISTED = 1000  # properties named one by one in a scan
HOT_ROWS = 1_000_000  # rows of one subject in a property from which on its buckets are not used
_LAYOUT = "_layout"

RAW_SCHEMA = "s STRING, o STRING, p STRING"
ENCODED_SCHEMA = "s BIGINT, o STRING, o_id BIGINT, p BIGINT"

# Characters Spark writes as %XX in partition directories,
# besides control characters.
ESCAPED = "\"#%'*/:=?\\{[]^\x7f"


def write_properties(triples: DataFrame, path: str, n_buckets: int | None = None) -> None:
    """Write one Parquet partition per property in a single job.

    With `n_buckets` each property is also dealt to so many buckets by its
    subjects, the same for all properties: joins of properties on the subject
    then need no exchange. A store of k properties gets at least k * n_buckets
    files, so the number should follow from the size of a usual property.

    The rows are rebalanced by property: small properties end up in one file,
    and adaptive execution splits a large one over as many tasks as its size
    asks for. Files are sorted by subject, which lets a scan for one subject
    skip row groups and pages; object ids of encoded triples get a Parquet
    Bloom filter for the same use. Their text is left out on the way, where it
    is just the id, and made again from it.
    """
    columns = ["s", "o", "o_id", "p"] if is_encoded(triples) else ["s", "o", "p"]
    rows = triples.select(*columns)
    if is_encoded(triples):
        text_of_id = F.col("o_id").cast("string")
        rows = rows.withColumn("o", F.when(~F.col("o").eqNullSafe(text_of_id), F.col("o")))
    # by subject, a partition holds whole buckets, and a hot subject is still split
    dealt = rows.hint("rebalance", F.col("p")) if n_buckets is None else rows.hint("rebalance", n_buckets, F.col("s"))
    ordered = dealt.sortWithinPartitions("p", "s")
    if is_encoded(triples):
        ordered = ordered.withColumn("o", F.coalesce(F.col("o"), text_of_id))
    writer = ordered.write.mode("overwrite").partitionBy("p")
    if is_encoded(triples):
        writer = writer.option("parquet.bloom.filter.enabled#o_id", "true")
    with write_settings(triples.sparkSession):
        if n_buckets is None:
            writer.parquet(path)
        else:
            writer.bucketBy(n_buckets, "s").sortBy("s").option("path", path).saveAsTable(_table_name(path))
    if n_buckets is not None:
        _write_layout(triples.sparkSession, path, is_encoded(triples), n_buckets)


def _table_name(path: str) -> str:
    """The session's name for the bucketed table at a path."""
    return "tripleweft_" + hashlib.sha256(path.rstrip("/").encode()).hexdigest()[:32]


def _write_layout(spark: SparkSession, path: str, encoded: bool, n_buckets: int) -> None:
    """A row per property beside the data: `p, n_buckets, most`, the rows of its most frequent subject."""
    table = scan_properties(spark, path, encoded=encoded)
    most = table.groupBy("p", "s").agg(F.count(F.lit(1)).alias("n")).groupBy("p").agg(F.max("n").alias("most"))
    most.select("p", F.lit(n_buckets).alias("n_buckets"), "most").write.mode("overwrite").parquet(f"{path}/{_LAYOUT}")


def _read_layout(spark: SparkSession, path: str, encoded: bool) -> tuple[int | None, set | None]:
    """The number of buckets, and the properties with a hot subject; None: too many to name."""
    schema = f"p {'BIGINT' if encoded else 'STRING'}, n_buckets INT, most BIGINT"
    try:
        layout = spark.read.schema(schema).parquet(f"{path.rstrip('/')}/{_LAYOUT}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None, set()
    n_buckets = layout.agg(F.max("n_buckets")).first()[0]
    hot = [row["p"] for row in layout.where(F.col("most") > HOT_ROWS).select("p").limit(MAX_LISTED + 1).collect()]
    return n_buckets, None if len(hot) > MAX_LISTED else set(hot)


def scan_properties(
    spark: SparkSession, path: str, props: Iterable | None = None, encoded: bool = True
) -> DataFrame:
    """Read all properties, or only the partitions of `props`.

    The schema is fixed, so no file is opened to learn it and property names
    keep their type. Given properties are read by their directories: the
    planner then sees their own size, not that of the whole store, and knows
    when one is small enough to broadcast.
    """
    reader = spark.read.schema(ENCODED_SCHEMA if encoded else RAW_SCHEMA)
    columns = ["s", "p", "o", *(["o_id"] if encoded else [])]
    if props is None:
        return reader.parquet(path).select(*columns)
    wanted = list(props)
    folders = [f"{path.rstrip('/')}/p={_escape(str(p))}" for p in wanted]
    try:
        table = reader.option("basePath", path).parquet(*folders)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        table = reader.parquet(path).where(F.col("p").isin(wanted))  # some are not stored
    return table.select(*columns)


def _escape(value: str) -> str:
    return "".join(f"%{ord(c):02X}" if c in ESCAPED or c < " " else c for c in value)


class PropertyStore:
    """A stored property table as the source of queries and reductions.

    It stands where a DataFrame of triples does; each pattern and partner
    column then reads the directory of its own property. With `filters`, those
    of all properties, a pattern with a variable predicate and a constant node
    reads only the properties whose filters hold the node.
    """

    def __init__(
        self, spark: SparkSession, path: str, encoded: bool = True, filters: DataFrame | None = None
    ):
        self.sparkSession = spark
        self.path = path
        self.encoded = encoded
        self.filters = filters
        self.stats = self.dictionary = None  # given by `open_store`
        self.table = scan_properties(spark, path, encoded=encoded)
        self.columns = self.table.columns
        self.n_buckets, self.hot = _read_layout(spark, path, encoded)
        if self.n_buckets is not None:
            self._register()

    def _register(self) -> None:
        """Make the buckets known to this session; properties of later writes are found as well."""
        schema = ENCODED_SCHEMA if self.encoded else RAW_SCHEMA
        self.sparkSession.sql(
            f"CREATE TABLE IF NOT EXISTS {_table_name(self.path)} ({schema}) USING parquet PARTITIONED BY (p) "
            f"CLUSTERED BY (s) SORTED BY (s) INTO {self.n_buckets} BUCKETS LOCATION :path", {"path": self.path})
        self.sparkSession.sql(f"MSCK REPAIR TABLE {_table_name(self.path)}")

    def properties(self, props: Iterable) -> DataFrame:
        return scan_properties(self.sparkSession, self.path, props, self.encoded)

    def property(self, p) -> DataFrame:
        """The rows of one property, by its buckets where there are any.

        Joins of bucketed properties on their subjects need no exchange, so
        adaptive execution cannot split a subject there. A property with a hot
        subject is read without its buckets; its joins exchange and split it.
        """
        if self.n_buckets is None or self.hot is None or p in self.hot:
            return self.properties([p])
        return self.sparkSession.table(_table_name(self.path)).where(F.col("p") == F.lit(p)).select(*self.columns)


def only_properties(triples: DataFrame | PropertyStore, properties: DataFrame) -> DataFrame:
    """The rows of the properties in `properties` (column `p`).

    A short list, which is the usual case, becomes a constant filter, so that
    other partitions are not even listed. A long one is joined.
    """
    wanted = properties.select("p").distinct()
    first = [row["p"] for row in wanted.limit(MAX_LISTED + 1).collect()]
    if len(first) > MAX_LISTED:
        return all_rows(triples).join(broadcast_if_small(wanted), "p", "left_semi")
    if not first:
        return all_rows(triples).where(F.lit(False))
    if isinstance(triples, PropertyStore):
        return triples.properties(first)
    return triples.where(F.col("p").isin(first))


def version_of(triples: DataFrame | PropertyStore) -> str:
    """A hash of the names of the files behind `triples`; empty if there are none.

    Spark gives every file it writes a name of its own, so added or rewritten
    triples have another version. It is taken from the listing, without a scan.
    """
    table = all_rows(triples)
    if isinstance(triples, PropertyStore):  # list anew: the store may have grown since it was opened
        table = scan_properties(triples.sparkSession, triples.path, encoded=triples.encoded)
    files = sorted(table.inputFiles())
    return hashlib.sha256("\n".join(files).encode()).hexdigest() if files else ""


def all_rows(triples: DataFrame | PropertyStore) -> DataFrame:
    """The whole table of a source."""
    return triples.table if isinstance(triples, PropertyStore) else triples


def rows_of(triples: DataFrame | PropertyStore, p) -> DataFrame:
    """The rows of one property of a source."""
    if isinstance(triples, PropertyStore):
        return triples.property(int(p) if triples.encoded else p)
    table = all_rows(triples)
    return table.where(position_equals(table, "p", p))
