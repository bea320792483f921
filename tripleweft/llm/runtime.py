"""What every operator here needs of a session: its code on the workers, bounded batches, files."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from tripleweft.session import configure, materialize, scratch_path

__all__ = ["prepare", "materialize", "scratch_path", "open_store", "read_table"]

# rows and bytes handed to Python at once; texts differ in length by far, and one longer than that comes alone
BATCH_ROWS, BATCH_BYTES = 512, 32 << 20

_shipped: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Set the run-time options and give the workers this package's code.

    Arrow batches are bounded by rows and bytes, for all later work of the session.
    A session whose workers cannot import the package gets it as a zip by
    `addPyFile`, once per application.
    """
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(prefix="package-")) / f"{package.name}.zip"
        with zipfile.ZipFile(target, "w") as archive:
            for path in sorted(package.rglob("*.py")):
                archive.write(path, path.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(target))
        _shipped.add(app)
    return spark


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a shared folder, for byte-range access from tasks."""
    if ":" not in uri.split("/")[0]:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
