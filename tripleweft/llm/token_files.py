"""Token counts by separator scan over flat token files.

A token file is nothing but token ids in a row, each document closed by the
end-of-document id; there is no index. The scan deals fixed-size blocks of all
files to the tasks, searches each block for the separator at once, and stitches
documents across blocks by a prefix scan over one small row per block.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripleweft.llm.arrays import slices
from tripleweft.llm.runtime import materialize, open_store, prepare, scratch_path

BLOCK_BYTES = 4 << 20
FILE_BYTES = 256 << 20  # a file is closed at the next document beyond this size
VOCABULARY, SEPARATOR, WIDTH = "/opt/tokenizers/byte_bpe_50k.tiktoken", 50256, 2

# Fixed value: the split pattern the public vocabulary was made with.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@cache
def encoder(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a rank file; loaded once per worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_token_files(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, separator: int = SEPARATOR, width: int = WIDTH) -> DataFrame:
    """Tokenise `doc_id, text` into flat files below `folder`; returns their manifest.

    The manifest, `path, ordinal, doc_id`, says which document is which in a
    file; the scan does not use it. Every task attempt writes files of its own
    names and only those in the manifest count, so an attempt that was lost or
    ran twice does no harm. Null and empty texts are documents of no tokens;
    repeated rows are documents of their own; an empty table gives no file.
    `vocabulary` must be readable under one path on all workers.
    """
    prepare(docs.sparkSession)
    if width not in (2, 4) or separator >= 1 << (8 * width):
        raise ValueError("ids and the separator must fit into width, 2 or 4 bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        out, name, size, ordinal = None, "", 0, 0
        encode = encoder(vocabulary).encode_ordinary
        for part in slices(batches):
            paths, ordinals = [], []
            for text in part.column("text").to_pylist():
                if out is None or size >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, size, ordinal = f"{uuid.uuid4().hex}.bin", 0, 0
                    out = store.open_output_stream(f"{root}/{name}")
                ids = np.array([*encode(text or ""), separator], f"<u{width}")
                out.write(ids.tobytes())
                paths.append(name)
                ordinals.append(ordinal)
                size += ids.nbytes
                ordinal += 1
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(ordinals, pa.int64()), part.column("doc_id")], ["path", "ordinal", "doc_id"])
        if out is not None:
            out.close()

    kind = dict(docs.dtypes)["doc_id"]
    manifest = docs.select("doc_id", "text").mapInArrow(run, f"path string, ordinal bigint, doc_id {kind}")
    return materialize(manifest, "token-manifest")


def _blocks(spark: SparkSession, folder: str) -> DataFrame:
    """`path, block, size` for every block of the files, whose sizes Spark lists without reading them."""
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("path"), F.col("length").alias("size"))
    last = F.floor((F.col("size") - 1) / BLOCK_BYTES)
    return files.where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("block"))


def _find(folder: str, separator: int, width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        for part in batches:
            for row in part.to_pylist():
                start = row["block"] * BLOCK_BYTES
                with store.open_input_file(f"{root}/{row['path']}") as file:
                    file.seek(start)
                    data = file.read(min(BLOCK_BYTES, row["size"] - start))
                ids = np.frombuffer(data, f"<u{width}", len(data) // width)  # half an id: a file cut short
                ends = start // width + np.flatnonzero(ids == separator)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["path"]]), pa.array([row["block"]], pa.int64()), pa.array([row["size"] // width], pa.int64()), pa.array([ends], pa.list_(pa.int64()))],
                    ["path", "block", "n_tokens", "ends"],
                )

    return run


def count_tokens(spark: SparkSession, folder: str, separator: int = SEPARATOR, width: int = WIDTH) -> DataFrame:
    """`path, ordinal, start, n_tokens, closed` for every document of the files in `folder`.

    `start` and `n_tokens` count ids, the separator aside. Tokens after a
    file's last separator are a document that is not `closed`. Blocks are read
    independently; the prefix scan runs over two numbers per block.
    """
    prepare(spark)
    blocks = _blocks(spark, folder)
    found = materialize(blocks.repartition(F.xxhash64("path", "block")).mapInArrow(_find(folder, separator, width), "path string, block bigint, n_tokens bigint, ends array<bigint>"), "separators")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = found.select("path", "block", F.size("ends").alias("n"), F.array_max("ends").alias("last")).select(
        "path", "block",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
        F.coalesce(F.max("last").over(before), F.lit(-1)).cast("bigint").alias("end_before"),
    )
    closed = found.join(carried, ["path", "block"]).select(
        "path", "n_before", "end_before", "ends", F.posexplode("ends").alias("k", "end")
    ).select(
        "path",
        (F.col("n_before") + F.col("k")).alias("ordinal"),
        (F.when(F.col("k") == 0, F.col("end_before")).otherwise(F.try_element_at("ends", F.col("k"))) + 1).alias("start"),
        "end",
        F.lit(True).alias("closed"),
    )
    tail = (
        found.groupBy("path")
        .agg(F.coalesce(F.sum(F.size("ends")), F.lit(0)).alias("ordinal"), (F.coalesce(F.max(F.array_max("ends")), F.lit(-1)) + 1).alias("start"), F.max("n_tokens").alias("end"))
        .where(F.col("start") < F.col("end"))
        .withColumn("closed", F.lit(False))
    )
    return closed.unionByName(tail).select("path", "ordinal", "start", (F.col("end") - F.col("start")).alias("n_tokens"), "closed")


def token_report(docs: DataFrame, vocabulary: str = VOCABULARY, separator: int = SEPARATOR, width: int = WIDTH) -> DataFrame:
    """`doc_id, n_tokens` of every document: written as token files, counted by the scan."""
    folder = scratch_path(docs.sparkSession, "tokens")
    manifest = write_token_files(docs, folder, vocabulary, separator, width)
    if manifest.isEmpty():
        return manifest.select("doc_id", F.lit(None).cast("bigint").alias("n_tokens"))
    counts = count_tokens(docs.sparkSession, folder, separator, width)
    return manifest.join(counts, ["path", "ordinal"]).select("doc_id", "n_tokens")
