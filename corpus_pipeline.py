"""The corpus pipeline: five stages from `documents` to a mix for training.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes
each result as Parquet and rereads it as the next stage's documents. All but
the last return the columns of `documents`.

In every stage further columns do no harm, whatever their names, and an empty
table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tripleweft.llm.contamination import drop_contaminated
from tripleweft.llm.mixing import mix_sources
from tripleweft.llm.near_duplicates import keep_first
from tripleweft.llm.passages import keep_quality, train_quality
from tripleweft.llm.runtime import materialize, read_table
from tripleweft.llm.secrets import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects.

    A score of just the threshold stays. Null and empty texts are scored as
    texts without words; rows that repeat are scored alike.
    """
    return keep_quality(docs, train_quality(docs, read_table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates.

    Rows without words or without a doc_id all stay. Each row is judged by its
    own text; of rows that repeat a doc_id with equal shingles one stays.
    """
    return keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that contain a benchmark item.

    A containment of just 0.75 counts. Null and empty texts contain nothing;
    rows that repeat are judged alike.
    """
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked.

    Null and empty texts stay as they are; overlapping secrets get one mask.
    """
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every use of a document in the mix of sources, with its place.

    Null and empty texts are used once; a null source is a source of its own;
    rows that repeat are documents of their own.
    """
    return mix_sources(docs)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("mixing", mixing),
]

# a trained model, MinHash and seeded permutations: not expressible in SQL
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
