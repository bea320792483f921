"""What a term is: variable, literal or resource, raw or encoded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POSITIONS = ("s", "p", "o")

UNKNOWN_ID = -1  # stands for a constant the dictionary lacks; no term has it


def is_variable(term) -> bool:
    """True for pattern terms such as "?x"."""
    return isinstance(term, str) and term.startswith("?")


def is_literal_text(term) -> bool:
    """True for pattern terms such as '"10.10"' or '"label"@en'."""
    return isinstance(term, str) and term.startswith('"')


def is_resource(term) -> bool:
    """True for constants that name a node: an IRI, a blank node or an id."""
    return not is_variable(term) and not is_literal_text(term)


def is_literal(column) -> Column:
    """Column version of `is_literal_text`."""
    return F.startswith(F.col(column) if isinstance(column, str) else column, F.lit('"'))


def is_encoded(triples: DataFrame) -> bool:
    """Encoded triples carry the object's id in a column of its own."""
    return "o_id" in triples.columns


def as_id(df: DataFrame, name: str) -> Column:
    """A column of ids, or of their text, as ids; null for literals and other text.

    Only digits are cast: Spark reports a failed cast by an exception inside,
    which takes longer than all else that is done for the row.
    """
    column = F.col(name)
    if df.schema[name].dataType.typeName() != "string":
        return column.cast("bigint")
    return F.when(column.rlike("^[0-9]+$"), column.try_cast("bigint"))


def object_key(triples: DataFrame) -> Column:
    """The object as a node: its id or IRI, null for literals."""
    if is_encoded(triples):
        return F.col("o_id")
    return F.when(~is_literal("o"), F.col("o"))


def position_key(triples: DataFrame, position: str) -> Column:
    """A position as something that may equal a subject, null for literals."""
    return object_key(triples) if position == "o" else F.col(position)


def position_equals(triples: DataFrame, position: str, term) -> Column:
    """Filter for a constant."""
    if not is_encoded(triples):
        return F.col(position) == F.lit(term)
    if position == "o" and is_literal_text(term):
        return F.col("o") == F.lit(term)
    return position_key(triples, position) == F.lit(int(term)).cast("bigint")
