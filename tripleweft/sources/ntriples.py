"""Text sources and sinks: N-Triples and encoded lines, dictionary, prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Subject and predicate, then an object, a final dot and perhaps a comment.
# Blanks may be spaces or tabs and may be missing where a bracket or a quote
# ends a term. A literal ends at its first quote that is not escaped.
_NODE = r'(?:<([^<>"]+)>|([^\s<>"#]\S*)(?=\s))'
_TAG = r"(?:@[A-Za-z0-9-]+|\^\^<[^<>]*>|\^\^[^\s<>\".]+)?"
_LITERAL = rf'("[^"\\]*+(?:\\.[^"\\]*+)*+"{_TAG})'
_STATEMENT = rf'^\s*{_NODE}\s*{_NODE}\s*(?:<([^<>"]+)>|([^\s<>"#]\S*?)|{_LITERAL})\s*\.\s*(?:#.*)?$'
_NO_STATEMENT = r"^\s*(?:#.*)?$"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(~F.rlike("value", F.lit(_NO_STATEMENT)))


def read_ntriples(spark: SparkSession, path: str, sep: str | None = None, mode: str = "skip") -> DataFrame:
    """`s, p, o` from N-Triples files, one statement per line ending in `.`.

    Angle brackets are taken off; literals keep their spaces, quotes, tags and
    datatypes. Spaces and tabs may separate terms in any mixture, so `sep`
    makes no difference and is kept for callers that name one. Blank lines and
    comments are no statements. Other lines that are not read are skipped, those
    with an empty term `<>` or a literal with bare quotes inside among them, and
    `refused_lines` returns them; with `mode="fail"` they raise an error.
    """
    if mode not in ("skip", "fail"):
        raise ValueError(f"mode is skip or fail, not {mode!r}")
    line = F.col("value")

    def group(*numbers: int) -> Column:
        found = [F.nullif(F.regexp_extract(line, _STATEMENT, k), F.lit("")) for k in numbers]
        return F.coalesce(*found)

    read = F.rlike(line, F.lit(_STATEMENT))
    lines = _lines(spark, path)
    if mode == "fail":
        refused = F.raise_error(F.concat(F.lit("not a statement: "), line)).cast("boolean")
        read = F.when(read, F.lit(True)).otherwise(refused)
    parsed = lines.where(read).select(group(1, 2).alias("s"), group(3, 4).alias("p"), group(5, 6, 7).alias("o"))
    return parsed


def refused_lines(spark: SparkSession, path: str) -> DataFrame:
    """`value`: the lines that `read_ntriples` skips and that are neither blank nor comments."""
    return _lines(spark, path).where(~F.rlike("value", F.lit(_STATEMENT)))


def read_encoded(spark: SparkSession, path: str) -> DataFrame:
    """`s, p, o, o_id` from lines `id id rest`; malformed lines are skipped."""
    fields = F.split(F.col("value"), " ", 3)
    return (
        spark.read.text(path)
        .select(fields.alias("f"))
        .where(F.size("f") == 3)
        .select(
            F.col("f")[0].try_cast("bigint").alias("s"),
            F.col("f")[1].try_cast("bigint").alias("p"),
            F.col("f")[2].alias("o"),
            F.col("f")[2].try_cast("bigint").alias("o_id"),
        )
        .where("s IS NOT NULL AND p IS NOT NULL")
    )


def write_encoded(enc: DataFrame, path: str) -> None:
    """Text lines `s p o`."""
    enc.select(F.concat_ws(" ", "s", "p", "o").alias("value")).write.mode("overwrite").text(path)


def export_dictionary(dictionary: DataFrame, path: str) -> None:
    """Text lines `id<TAB>term`, unquoted."""
    line = F.concat_ws("\t", "id", "term").alias("value")
    dictionary.select(line).write.mode("overwrite").text(path)


def read_prefixes(spark: SparkSession, path: str) -> DataFrame:
    """`prefix, iri` from a JSON file with one object under `@context`."""
    context = spark.read.schema("`@context` MAP<STRING, STRING>").json(path, multiLine=True)
    return context.select(F.explode("`@context`").alias("prefix", "iri"))
