"""Triples derived from the star schema, by one SQL text.

The text runs unchanged in Spark SQL and in other SQL engines; table names are
written as fields so that Spark can fill in DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "orders", "lineitem")

EX = "http://ex.org/"


def _node(kind: str, key: str) -> str:
    return f"'{EX}{kind}/' || CAST({key} AS STRING)"


def _literal(value: str) -> str:
    return f"'\"' || CAST({value} AS STRING) || '\"'"


def _branch(s: str, prop: str, o: str, table: str) -> str:
    return f"SELECT {s} AS s, '{EX}p/{prop}' AS p, {o} AS o FROM {{{table}}}"


_N_CUSTOMERS = "(SELECT COUNT(*) FROM {customer})"
_NEXT = f"(c_custkey * 7) % {_N_CUSTOMERS}"
_P = f"'{EX}p/"

TRIPLES_TEMPLATE = "\nUNION ALL\n".join(
    [
        _branch(_node("region", "r_regionkey"), "name", _literal("r_name"), "region"),
        _branch(_node("nation", "n_nationkey"), "name", _literal("n_name"), "nation"),
        _branch(_node("nation", "n_nationkey"), "inRegion", _node("region", "n_regionkey"), "nation"),
        _branch(_node("customer", "c_custkey"), "inNation", _node("nation", "c_nationkey"), "customer"),
        _branch(_node("customer", "c_custkey"), "segment", _literal("c_mktsegment"), "customer"),
        _branch(_node("customer", "c_custkey"), "follows", _node("customer", _NEXT), "customer"),
        _branch(
            _node("customer", "c_custkey"),
            "knows",
            _node("customer", f"CASE WHEN c_custkey % 2 = 0 THEN {_NEXT} ELSE c_custkey END"),
            "customer",
        ),
        _branch(_node("supplier", "s_suppkey"), "inNation", _node("nation", "s_nationkey"), "supplier"),
        _branch(_node("order", "o_orderkey"), "placedBy", _node("customer", "o_custkey"), "orders"),
        _branch(_node("order", "o_orderkey"), "status", _literal("o_orderstatus"), "orders"),
        _branch(_node("order", "l_orderkey"), "contains", _node("part", "l_partkey"), "lineitem"),
        _branch(_node("order", "l_orderkey"), "shippedBy", _node("supplier", "l_suppkey"), "lineitem"),
        # rows for patterns that repeat a variable
        f"SELECT {_P}self', {_P}self', {_P}self'",
        f"SELECT {_P}label', {_P}label', '\"label\"@en'",
        f"SELECT {_P}follows', {_P}label', {_P}label'",
        f"SELECT '{EX}customer/0', {_P}label', {_P}label'",
    ]
)

TRIPLES_SQL = TRIPLES_TEMPLATE.format(**{name: name for name in TABLES})


def star_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`s, p, o` of all rows of the tables in `sf_dir`."""
    tables = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in TABLES}
    return spark.sql(TRIPLES_TEMPLATE, **tables)
