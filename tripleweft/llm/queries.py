"""The queries of this subpackage's operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tripleweft.llm import divergence, hard_negatives, oracles
from tripleweft.llm.bpe import bpe_report
from tripleweft.llm.contamination import find_contamination
from tripleweft.llm.licenses import license_report
from tripleweft.llm.mixing import mix_sources
from tripleweft.llm.near_duplicates import near_duplicates
from tripleweft.llm.passages import quality_report
from tripleweft.llm.quality_rules import quality_rules
from tripleweft.llm.repeated_passages import repeat_report
from tripleweft.llm.runtime import read_table
from tripleweft.llm.secrets import secret_report
from tripleweft.llm.token_files import token_report
from tripleweft.llm.warc import warc_report


def _over(operator: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(*[read_table(spark, sf_dir, name) for name in tables])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": _over(token_report, "documents"),
    "op2_substring_dedup": _over(repeat_report, "documents"),
    "op3_secret_scan": _over(secret_report, "documents"),
    "op4_minhash_near_dedup": _over(near_duplicates, "documents"),
    "op5_quality_classifier": _over(quality_report, "documents", "labels"),
    "op6_warc": _over(warc_report, "pages"),
    "op7_license_scan": _over(license_report, "documents"),
    "op8_quality_rules": _over(quality_rules, "documents"),
    "op9_source_mixing": _over(mix_sources, "documents"),
    "op10_decontamination": _over(find_contamination, "documents", "benchmark"),
    "op11_bpe_codec": _over(bpe_report, "documents"),
    "op12_source_divergence": _over(divergence.divergence_report, "documents"),
    "op13_hard_negatives": _over(hard_negatives.hard_negatives, "embeddings"),
}
ORACLES: dict[str, str] = {
    "op2_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op4_minhash_near_dedup": oracles.NEAR_DUPLICATES,
    "op6_warc": oracles.WARC,
    "op10_decontamination": oracles.CONTAMINATION,
    "op12_source_divergence": divergence.SQL,
    "op13_hard_negatives": hard_negatives.SQL,
}
