"""

Every query runs over the whole triples derived from the star schema in
`sf_dir` (see `tripleweft.fixtures`). Queries named `..._enc` run on the
dictionary-encoded property store and decode their results.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import tripleweft as tw
from tripleweft.fixtures import EX, TABLES, TRIPLES_SQL, star_triples
from tripleweft.plans.stores import stored_bytes
from tripleweft.session import scratch_path

P = EX + "p/"
CONTAINS, SHIPPED, PLACED, STATUS = (P + n for n in ("contains", "shippedBy", "placedBy", "status"))
FOLLOWS, KNOWS, SEGMENT, NATION = (P + n for n in ("follows", "knows", "segment", "inNation"))
REGION, NAME, LABEL, SELF = (P + n for n in ("inRegion", "name", "label", "self"))


def customer(key) -> str:
    return f"{EX}customer/{key}"


Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def _register(name: str, run: Query, sql: str | None = None) -> None:
    def configured(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(tw.configure(spark, _input_bytes(spark, sf_dir)), sf_dir)

    _QUERIES[name] = configured
    if sql is not None:
        _ORACLES[name] = _with_tables(sql)


# ---------------------------------------------------------------- shared inputs

_TRIPLES_CTE = f"""WITH triples AS MATERIALIZED (
{TRIPLES_SQL}
)"""
_DICT_CTE = """, dict AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY term) AS id, term FROM (
    SELECT s AS term FROM triples UNION SELECT p FROM triples
    UNION SELECT o FROM triples WHERE o NOT LIKE '"%') AS terms
)"""
_ENC_CTE = """, enc AS MATERIALIZED (
  SELECT ds.id AS s, dp.id AS p, coalesce(CAST(dob.id AS VARCHAR), t.o) AS o, dob.id AS o_id
  FROM triples t JOIN dict ds ON ds.term = t.s JOIN dict dp ON dp.term = t.p
  LEFT JOIN dict dob ON dob.term = t.o
)"""


def _with_tables(sql: str) -> str:
    """The SQL after the tables it names, each computed once."""
    names = set(re.findall(r"\b(?:dict|enc)\b", sql))
    tables = _TRIPLES_CTE + _DICT_CTE * bool(names) + _ENC_CTE * ("enc" in names)
    return f"{tables}\n{sql}"


_SHARED: dict[tuple, object] = {}


def _shared(kind: str, spark: SparkSession, sf_dir: str, make: Callable):
    """Tables several queries start from, written once per application."""
    key = (kind, spark.sparkContext.applicationId, sf_dir)
    if key not in _SHARED:
        _SHARED[key] = make()
    return _SHARED[key]


def _input_bytes(spark: SparkSession, sf_dir: str) -> int:
    return _shared(
        "bytes", spark, sf_dir,
        lambda: sum(stored_bytes(spark, f"{sf_dir}/{name}.parquet") for name in TABLES),
    )


def _dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shared(
        "dict", spark, sf_dir,
        lambda: tw.materialize(tw.build_dictionary(star_triples(spark, sf_dir)), "dictionary"),
    )


def _property_store(spark: SparkSession, sf_dir: str) -> tw.PropertyStore:
    def make() -> tw.PropertyStore:
        path = scratch_path(spark, "store")
        encoded = tw.encode_triples(star_triples(spark, sf_dir), _dictionary(spark, sf_dir))
        tw.write_properties(encoded, path)
        return tw.PropertyStore(spark, path)

    return _shared("store", spark, sf_dir, make)


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _property_store(spark, sf_dir).table


def _filters(spark: SparkSession, sf_dir: str, kind: str = "exact") -> DataFrame:
    def make() -> DataFrame:
        path = scratch_path(spark, "filters")
        tw.write_filters(tw.build_all_filters(_store(spark, sf_dir), kind, 0.01), path)
        return spark.read.parquet(path)

    return _shared("filters-" + kind, spark, sf_dir, make)


def _id(spark: SparkSession, sf_dir: str, term: str) -> int | None:
    return tw.encode_query([(term, "?p", "?o")], _dictionary(spark, sf_dir))[0][0]


def _raw_property_store(spark: SparkSession, sf_dir: str) -> tw.PropertyStore:
    def make() -> tw.PropertyStore:
        path = scratch_path(spark, "raw-store")
        tw.write_properties(star_triples(spark, sf_dir), path)
        return tw.PropertyStore(spark, path, encoded=False)

    return _shared("raw", spark, sf_dir, make)


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw_property_store(spark, sf_dir).table


def _on_raw(run: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: run(_raw(spark, sf_dir))


def _on_store(run: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: run(_store(spark, sf_dir))


def _node(alias: str) -> str:
    return f"{alias} NOT LIKE '\"%'"


# ---------------------------------------------------------------- sources, sinks


def _statements(triples: DataFrame, sep: str) -> DataFrame:
    def wrap(name: str):
        return F.when(F.startswith(F.col(name), F.lit('"')), F.col(name)).otherwise(
            F.concat(F.lit("<"), F.col(name), F.lit(">"))
        )

    return triples.select(
        F.concat(wrap("s"), F.lit(sep), wrap("p"), F.lit(sep), wrap("o"), F.lit(" .")).alias("value")
    )


def _round_trip_ntriples(sep_name: str, sep: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = scratch_path(spark, "nt")
        _statements(_raw(spark, sf_dir), sep).write.text(path)
        return tw.read_ntriples(spark, path, sep_name)

    return run


_register("a1_read_ntriples", _round_trip_ntriples("space", " "), "SELECT s, p, o FROM triples")
_register("a1_read_ntriples_tab", _round_trip_ntriples("tab", "\t"), "SELECT s, p, o FROM triples")


def _mixed_ntriples(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "nt")
    mixed = F.regexp_replace("value", "> ", ">\t")
    commented = F.concat(mixed, F.when(F.pmod(F.xxhash64("value"), F.lit(3)) == 0, ' # a "note" .').otherwise(""))
    _statements(_raw(spark, sf_dir), " ").select(commented.alias("value")).write.text(path)
    return tw.read_ntriples(spark, path, mode="fail")


_register("a1_read_ntriples_mixed", _mixed_ntriples, "SELECT s, p, o FROM triples")


def _refused_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each statement once as it is and once broken, in a way that its hash chooses."""
    path = scratch_path(spark, "nt")
    lines = _statements(_raw(spark, sf_dir), " ")
    way = F.pmod(F.xxhash64("value"), F.lit(3))
    broken = (
        F.when(way == 0, F.regexp_replace("value", "^<[^>]*>", "<>"))
        .when(way == 1, F.regexp_replace("value", r" \.$", ""))
        .otherwise(F.regexp_replace("value", r" \S+ \.$", ' "a" "b" .'))
    )
    lines.union(lines.select(broken)).write.text(path)
    read = tw.read_ntriples(spark, path).agg(F.count(F.lit(1)).alias("n_read"))
    refused = tw.refused_lines(spark, path).agg(F.count(F.lit(1)).alias("n_refused"))
    return read.withColumn("n_refused", refused.scalar())


_register("a1_refused_lines", _refused_lines, "SELECT count(*) AS n_read, count(*) AS n_refused FROM triples")


def _read_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "encoded")
    tw.write_encoded(_store(spark, sf_dir), path)
    return tw.read_encoded(spark, path)


def _write_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "encoded")
    tw.write_encoded(_store(spark, sf_dir), path)
    return spark.read.text(path)


_register("a2_read_encoded", _read_encoded, "SELECT s, p, o, o_id FROM enc")
_register(
    "a3_write_encoded", _write_encoded,
    "SELECT CAST(s AS VARCHAR) || ' ' || CAST(p AS VARCHAR) || ' ' || o AS value FROM enc",
)


def _raw_store(props=None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = scratch_path(spark, "raw-copy")
        tw.write_properties(_raw(spark, sf_dir), path)
        return tw.scan_properties(spark, path, props, encoded=False)

    return run


_register("a4_write_properties", _raw_store(), "SELECT s, p, o FROM triples")
_register(
    "a5_scan_properties", _raw_store([PLACED, STATUS, LABEL]),
    f"SELECT s, p, o FROM triples WHERE p IN ('{PLACED}', '{STATUS}', '{LABEL}')",
)
_register("a5_scan_properties_all_enc", _on_store(lambda t: t), "SELECT s, p, o, o_id FROM enc")


def _export_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tsv")
    tw.export_dictionary(_dictionary(spark, sf_dir), path)
    return spark.read.schema("id BIGINT, term STRING").csv(path, sep="\t", quote="")


_register("a8_export_dictionary", _export_dictionary, "SELECT id, term FROM dict")

# ---------------------------------------------------------------- dictionary

_register("b1_build_dictionary", _dictionary, "SELECT id, term FROM dict")


def _extend_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    triples = _raw(spark, sf_dir)
    known = tw.build_dictionary(triples.where(F.col("p").isin(PLACED, STATUS)))
    return tw.extend_dictionary(known, triples)


_register(
    "b2_extend_dictionary", _extend_dictionary,
    f""", base AS (
  SELECT row_number() OVER (ORDER BY term) AS id, term FROM (
    SELECT s AS term FROM triples WHERE p IN ('{PLACED}', '{STATUS}')
    UNION SELECT p FROM triples WHERE p IN ('{PLACED}', '{STATUS}')
    UNION SELECT o FROM triples WHERE p = '{PLACED}') AS terms
)
SELECT id, term FROM base
UNION ALL
SELECT (SELECT max(id) FROM base) + row_number() OVER (ORDER BY term) AS id, term
FROM dict WHERE term NOT IN (SELECT term FROM base)""",
)
_register(
    "b3_encode_triples",
    lambda spark, sf_dir: tw.encode_triples(_raw(spark, sf_dir), _dictionary(spark, sf_dir)),
    "SELECT s, p, o, o_id FROM enc",
)


def _encode_partly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of terms that a dictionary of some properties lacks are left out."""
    triples, dictionary = _raw(spark, sf_dir), _dictionary(spark, sf_dir)
    known = triples.where(F.col("p").isin(PLACED, STATUS)).select(F.explode(F.array("s", "p", "o")).alias("term"))
    return tw.encode_triples(triples, dictionary.join(known, "term", "left_semi"), unknown="drop")


_register(
    "b3_encode_partial_dictionary", _encode_partly,
    f""", known AS (
  SELECT id, term FROM dict WHERE term IN (SELECT s FROM triples WHERE p IN ('{PLACED}', '{STATUS}')
    UNION SELECT o FROM triples WHERE p = '{PLACED}') OR term IN ('{PLACED}', '{STATUS}')
)
SELECT ks.id AS s, kp.id AS p, coalesce(CAST(ko.id AS VARCHAR), t.o) AS o, ko.id AS o_id
FROM triples t JOIN known ks ON ks.term = t.s JOIN known kp ON kp.term = t.p LEFT JOIN known ko ON ko.term = t.o
WHERE ko.id IS NOT NULL OR t.o LIKE '"%'""",
)

# A workload that grows with the data: four patterns per customer, written for
# the customer's place in the `follows` chain.
_WORKLOAD_SQL = f"""
SELECT s AS query_id, 0 AS pattern_id, '?o' AS s, '{PLACED}' AS p, s AS o FROM triples WHERE p = '{FOLLOWS}'
UNION ALL
SELECT s, 1, '?o', '{STATUS}', '"F"' FROM triples WHERE p = '{FOLLOWS}'
UNION ALL
SELECT s, 2, o, '?p', '?v' FROM triples WHERE p = '{FOLLOWS}'
UNION ALL
SELECT s, 3, '?v', '{P}unheard', '?o' FROM triples WHERE p = '{FOLLOWS}'
UNION ALL
SELECT s, 4, '?v', CASE WHEN s = o THEN '{KNOWS}' ELSE '?q' END, '?v' FROM triples WHERE p = '{KNOWS}'
"""


def _workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_WORKLOAD_SQL.replace("FROM triples", "FROM {triples}"),
                     triples=_raw(spark, sf_dir))


def _resolved(name: str) -> str:
    return (
        f"CASE WHEN w.{name} LIKE '?%' OR w.{name} LIKE '\"%' THEN w.{name} "
        f"ELSE coalesce(CAST(d{name}.id AS VARCHAR), w.{name}) END AS {name}"
    )


_register(
    "b4_encode_patterns",
    lambda spark, sf_dir: tw.encode_patterns(_workload(spark, sf_dir), _dictionary(spark, sf_dir)),
    f""", w AS ({_WORKLOAD_SQL})
SELECT w.query_id, w.pattern_id, {_resolved("s")}, {_resolved("p")}, {_resolved("o")},
  (w.s LIKE '?%' OR ds.id IS NOT NULL) AND (w.p LIKE '?%' OR dp.id IS NOT NULL)
  AND (w.o LIKE '?%' OR w.o LIKE '"%' OR dobj.id IS NOT NULL) AS matched
FROM w LEFT JOIN dict ds ON ds.term = w.s LEFT JOIN dict dp ON dp.term = w.p
LEFT JOIN dict dobj ON dobj.term = w.o""".replace("do.id", "dobj.id"),
)

MINIMUM = [("?o", PLACED, "?c"), ("?c", NATION, "?n"), ("?o", STATUS, '"F"')]
_MINIMUM_SQL = f"""SELECT a.s AS o, a.o AS c, b.o AS n
FROM triples a JOIN triples b ON b.s = a.o AND b.p = '{NATION}'
JOIN triples f ON f.s = a.s AND f.p = '{STATUS}' AND f.o = '"F"'
WHERE a.p = '{PLACED}'"""


def _solve(patterns, select=None, reduced: bool = False, **options) -> Query:
    """A query on raw triples."""
    solve = tw.reduced_bgp if reduced else tw.bgp
    return lambda spark, sf_dir: solve(
        _raw_property_store(spark, sf_dir), patterns, select, **options)


def _solve_enc(patterns, select=None, reduced: bool = False, **options) -> Query:
    """The same on the encoded store, with constants and results translated."""
    solve = tw.reduced_bgp if reduced else tw.bgp

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        dictionary = _dictionary(spark, sf_dir)
        encoded = tw.encode_query(patterns, dictionary)
        return tw.decode_bindings(solve(_property_store(spark, sf_dir), encoded, select, **options), dictionary)

    return run


_register("b5_decode_bindings", _solve_enc(MINIMUM, ["o", "c", "n"]), _MINIMUM_SQL)


def _expand_curies(spark: SparkSession, sf_dir: str) -> DataFrame:
    curie = F.col("s")
    for prefix in ("customer", "order"):
        curie = F.regexp_replace(curie, f"^{EX}{prefix}/", f"{prefix[:3]}:")
    curie = F.regexp_replace(curie, f"^{EX}region/", "unheard:")
    prefixes = spark.createDataFrame(
        [("cus", EX + "customer/"), ("ord", EX + "order/")], "prefix STRING, iri STRING"
    )
    curies = _raw(spark, sf_dir).select(curie.alias("curie"), curie.alias("s"), "p", "o")
    return tw.expand_curies(curies, "s", prefixes)


_register(
    "b6_expand_curies", _expand_curies,
    f"""SELECT replace(replace(replace(s, '{EX}customer/', 'cus:'), '{EX}order/', 'ord:'),
  '{EX}region/', 'unheard:') AS curie, replace(s, '{EX}region/', 'unheard:') AS s, p, o FROM triples""",
)

# ---------------------------------------------------------------- triple patterns

_PATTERNS = {
    "c1_spo": (("?s", "?p", "?o"), "SELECT s, p, o FROM triples"),
    "c2_bound_o": (
        ("?s", "?p", EX + "nation/3"), f"SELECT s, p FROM triples WHERE o = '{EX}nation/3'"),
    "c3_bound_p": (("?s", PLACED, "?o"), f"SELECT s, o FROM triples WHERE p = '{PLACED}'"),
    "c4_bound_p_o": (
        ("?s", STATUS, '"F"'), f"SELECT s FROM triples WHERE p = '{STATUS}' AND o = '\"F\"'"),
    "c5_bound_s": ((customer(2), "?p", "?o"), f"SELECT p, o FROM triples WHERE s = '{customer(2)}'"),
    "c6_bound_s_o": (
        (customer(2), "?p", customer(14)),
        f"SELECT p FROM triples WHERE s = '{customer(2)}' AND o = '{customer(14)}'"),
    "c7_bound_s_p": (
        (EX + "order/15", SHIPPED, "?o"),
        f"SELECT o FROM triples WHERE s = '{EX}order/15' AND p = '{SHIPPED}'"),
    "c9_all_equal": (("?x", "?x", "?x"), "SELECT s AS x FROM triples WHERE s = p AND p = o"),
    "c10_s_equals_p": (("?x", "?x", "?o"), "SELECT s AS x, o FROM triples WHERE s = p"),
    "c11_self_loop": (("?x", "?p", "?x"), "SELECT s AS x, p FROM triples WHERE s = o"),
    "c12_p_equals_o": (("?s", "?x", "?x"), "SELECT s, p AS x FROM triples WHERE p = o"),
    "c13_s_equals_p_bound_o": (
        ("?x", "?x", SELF), f"SELECT s AS x FROM triples WHERE s = p AND o = '{SELF}'"),
    "c14_self_loop_bound_p": (
        ("?x", KNOWS, "?x"), f"SELECT s AS x FROM triples WHERE p = '{KNOWS}' AND s = o"),
    "c15_p_equals_o_bound_s": (
        (customer(0), "?x", "?x"),
        f"SELECT p AS x FROM triples WHERE s = '{customer(0)}' AND p = o"),
}


def _match(pattern) -> Query:
    return _on_raw(lambda triples: tw.match_pattern(triples, pattern))


for _name, (_pattern, _sql) in _PATTERNS.items():
    _register(_name, _match(_pattern), _sql)
    _register(_name + "_enc", _solve_enc([_pattern]), _sql)

FULLY_BOUND = (EX + "order/510", SHIPPED, EX + "supplier/3")
_register(
    "c8_fully_bound", _on_raw(lambda t: tw.count_results(tw.match_pattern(t, FULLY_BOUND))),
    f"""SELECT count(*) AS n_results FROM triples
WHERE s = '{FULLY_BOUND[0]}' AND p = '{SHIPPED}' AND o = '{FULLY_BOUND[2]}'""",
)
_register(
    "c8_fully_bound_enc",
    lambda spark, sf_dir: tw.count_results(tw.match_pattern(
        _store(spark, sf_dir), tw.encode_query([FULLY_BOUND], _dictionary(spark, sf_dir))[0])),
    f"""SELECT count(*) AS n_results FROM triples
WHERE s = '{FULLY_BOUND[0]}' AND p = '{SHIPPED}' AND o = '{FULLY_BOUND[2]}'""",
)

# ---------------------------------------------------------------- joins, projection

STAR = [("?o", PLACED, "?c"), ("?o", STATUS, "?st"), ("?o", SHIPPED, "?sup"),
        ("?o", CONTAINS, EX + "part/7")]
TWO = [("?x", KNOWS, "?y"), ("?x", FOLLOWS, "?y")]
UNBOUND = [(customer(2), "?p", "?o"), (customer(2), FOLLOWS, "?o")]
CYCLE = [("?x", KNOWS, "?y"), ("?x", NATION, "?n"), ("?y", FOLLOWS, "?z"), ("?z", NATION, "?n"),
         ("?o", PLACED, "?x")]


def _join(left, right) -> Query:
    return _on_raw(
        lambda t: tw.join_bindings(tw.match_pattern(t, left), tw.match_pattern(t, right))
    )


def _both(name: str, patterns, select, sql: str, **options) -> None:
    _register(name, _solve(patterns, select, **options), sql)
    _register(name + "_enc", _solve_enc(patterns, select, **options), sql)


_register(
    "d1_join_one", _join(("?o", PLACED, "?c"), ("?c", NATION, "?n")),
    f"""SELECT a.s AS o, a.o AS c, b.o AS n FROM triples a JOIN triples b ON a.o = b.s
WHERE a.p = '{PLACED}' AND b.p = '{NATION}'""",
)
_TWO_SQL = f"""SELECT a.s AS x, a.o AS y FROM triples a JOIN triples b ON a.s = b.s AND a.o = b.o
WHERE a.p = '{KNOWS}' AND b.p = '{FOLLOWS}'"""
_register("d2_join_two", _join(*TWO), _TWO_SQL)
_register("d2_join_two_enc", _solve_enc(TWO), _TWO_SQL)
_register(
    "d3_join_three", _join(("?x", "?p", "?y"), ("?x", "?p", "?y")),
    """SELECT a.s AS x, a.p AS p, a.o AS y FROM triples a
JOIN triples b ON a.s = b.s AND a.p = b.p AND a.o = b.o""",
)
_both(
    "d4_join_fully_bound", [("?o", PLACED, "?c"), FULLY_BOUND], None,
    f"""SELECT a.s AS o, a.o AS c FROM triples a, triples b WHERE a.p = '{PLACED}'
AND b.s = '{FULLY_BOUND[0]}' AND b.p = '{SHIPPED}' AND b.o = '{FULLY_BOUND[2]}'""",
)
_both(
    "d5_no_shared_variable", [("?o", STATUS, "?st"), ("?x", "?x", "?y")], None,
    f"SELECT a.s AS o, a.o AS st, b.s AS x, b.o AS y FROM triples a, triples b "
    f"WHERE a.p = '{STATUS}' AND b.s = b.p",
    allow_product=True,
)
_register(
    "d6_join_unbound_property",
    _on_raw(
        lambda t: tw.join_unbound_property(
            t, ("?c", "?p", "?v"), tw.match_pattern(t, ("?o", PLACED, "?c")))
    ),
    f"""SELECT a.s AS o, a.o AS c, b.p AS p, b.o AS v FROM triples a JOIN triples b ON a.o = b.s
WHERE a.p = '{PLACED}'""",
)


def _join_enc(first: tuple, second: tuple) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        enc, dictionary = _store(spark, sf_dir), _dictionary(spark, sf_dir)
        a, b = tw.encode_query([first, second], dictionary)
        found = tw.join_bindings(tw.match_pattern(enc, a), tw.match_pattern(enc, b))
        return tw.decode_bindings(found, dictionary)

    return run


# ids on one side, text on the other where an object may be a literal
for _name, _patterns in {
    "d1_join_one": (("?o", PLACED, "?c"), ("?c", NATION, "?n")),
    "d3_join_three": (("?x", "?p", "?y"), ("?x", "?p", "?y")),
    "d6_join_unbound_property": (("?o", PLACED, "?c"), ("?c", "?p", "?v")),
}.items():
    _register(_name + "_enc", _join_enc(*_patterns))
    _ORACLES[_name + "_enc"] = _ORACLES[_name]
_both(
    "d6_unbound_constant_subject", UNBOUND, ["p", "o"],
    f"""SELECT a.p AS p, a.o AS o FROM triples a JOIN triples b ON a.o = b.o
WHERE a.s = '{customer(2)}' AND b.s = '{customer(2)}' AND b.p = '{FOLLOWS}'""",
)
_both("d7_bgp_minimum", MINIMUM, ["o", "c", "n"], _MINIMUM_SQL)
_STAR_SQL = f"""SELECT a.s AS o, a.o AS c, b.o AS st, d.o AS sup FROM triples a
JOIN triples b ON b.s = a.s AND b.p = '{STATUS}' JOIN triples d ON d.s = a.s AND d.p = '{SHIPPED}'
JOIN triples e ON e.s = a.s AND e.p = '{CONTAINS}' AND e.o = '{EX}part/7' WHERE a.p = '{PLACED}'"""
_both("d7_bgp_star", STAR, ["o", "c", "st", "sup"], _STAR_SQL)
_CYCLE_SQL = f"""SELECT k.s AS x, k.o AS y, n.o AS n, f.o AS z, ord.s AS o FROM triples k
JOIN triples n ON n.s = k.s AND n.p = '{NATION}' JOIN triples f ON f.s = k.o AND f.p = '{FOLLOWS}'
JOIN triples m ON m.s = f.o AND m.p = '{NATION}' AND m.o = n.o
JOIN triples ord ON ord.o = k.s AND ord.p = '{PLACED}' WHERE k.p = '{KNOWS}'"""
_both("d7_bgp_cycle", CYCLE, ["x", "y", "n", "z", "o"], _CYCLE_SQL)
_both(
    "d7_bgp_shared_literal", [("?a", NAME, "?l"), ("?b", NAME, "?l")], None,
    f"""SELECT a.s AS a, a.o AS l, b.s AS b FROM triples a JOIN triples b ON a.o = b.o
WHERE a.p = '{NAME}' AND b.p = '{NAME}'""",
)
_both("d8_project_list", MINIMUM, ["?n", "?o"], f"SELECT n, o FROM ({_MINIMUM_SQL}) AS r")
_both(
    "d9_project_all", [("?s", "?p", "?s")], None, "SELECT s, p FROM triples WHERE s = o",
)

# ---------------------------------------------------------------- reductions


def _reduce_subject(triples: DataFrame) -> DataFrame:
    partners = [
        tw.partner_keys(triples, (PLACED, "o")),
        tw.partner_keys(triples.where("s <> o"), (KNOWS, "s")),
    ]
    return tw.reduce_subject(tw.match_pattern(triples, ("?s", SEGMENT, "?o")), partners)


_register(
    "f1_reduce_subject", _on_raw(_reduce_subject),
    f"""SELECT s, o FROM triples WHERE p = '{SEGMENT}'
AND s IN (SELECT o FROM triples WHERE p = '{PLACED}')
AND s IN (SELECT s FROM triples WHERE p = '{KNOWS}' AND s <> o)""",
)
_register(
    "f2_reduce_object",
    _on_raw(
        lambda t: tw.reduce_object(
            t, [tw.partner_keys(t, (KNOWS, "o")), tw.partner_keys(t, (PLACED, "o"))])
    ),
    f"""SELECT s, p, o FROM triples WHERE o LIKE '"%'
OR (o IN (SELECT o FROM triples WHERE p = '{KNOWS}')
    AND o IN (SELECT o FROM triples WHERE p = '{PLACED}'))""",
)
_register(
    "f3_reduce_pattern", _on_raw(lambda t: tw.reduce_pattern(t, CYCLE[0], CYCLE)),
    f"""SELECT s, p, o FROM triples WHERE p = '{KNOWS}'
AND s IN (SELECT s FROM triples WHERE p = '{NATION}')
AND s IN (SELECT o FROM triples WHERE p = '{PLACED}')
AND o IN (SELECT s FROM triples WHERE p = '{FOLLOWS}')""",
)
_register(
    "f3_reduce_pattern_loop", _on_raw(lambda t: tw.reduce_pattern(t, ("?x", KNOWS, "?x"), [])),
    f"""SELECT s, p, o FROM triples WHERE p = '{KNOWS}'
AND o IN (SELECT s FROM triples WHERE p = '{KNOWS}')""",
)
_register(
    "f3_reduce_unbound_loop",
    _on_raw(
        lambda t: tw.reduce_pattern(t, ("?x", "?p", "?x"), [("?o", PLACED, "?x"), ("?x", "?q", "?w")])
    ),
    f"""SELECT s, p, o FROM triples t WHERE s IN (SELECT o FROM triples WHERE p = '{PLACED}')
AND (o LIKE '"%' OR (o IN (SELECT o FROM triples WHERE p = '{PLACED}')
  AND o IN (SELECT s FROM triples)
  AND EXISTS (SELECT 1 FROM triples own WHERE own.p = t.p AND own.s = t.o)))""",
)

_register(
    "f4_reduction_keys",
    lambda spark, sf_dir: tw.reduction_keys(
        _workload(spark, sf_dir), _raw(spark, sf_dir).select("p").distinct()),
    f""", w AS ({_WORKLOAD_SQL}), props AS (SELECT DISTINCT p AS prop FROM triples),
own AS (
  SELECT w.*, w.s AS var, 's' AS col, CASE WHEN w.p LIKE '?%' THEN prop ELSE w.p END AS own_p
  FROM w LEFT JOIN props ON w.p LIKE '?%' WHERE w.s LIKE '?%'
  UNION ALL
  SELECT w.*, w.o AS var, 'o' AS col, CASE WHEN w.p LIKE '?%' THEN prop ELSE w.p END AS own_p
  FROM w LEFT JOIN props ON w.p LIKE '?%' WHERE w.o LIKE '?%'
), tags AS (
  SELECT DISTINCT a.query_id, a.pattern_id, a.col, a.own_p,
    CASE WHEN b.pattern_id = a.pattern_id THEN a.own_p WHEN b.p LIKE '?%' THEN 'ANY' ELSE b.p END
    || CASE WHEN b.s = a.var THEN '_TRPS' ELSE '_TRPO' END AS tag
  FROM own a JOIN w b ON b.query_id = a.query_id AND (b.s = a.var OR b.o = a.var)
)
SELECT query_id, pattern_id, col, own_p || CASE WHEN col = 's' THEN '_TRPS' ELSE '_TRPO' END || '_JOIN_'
  || string_agg(tag, '_JOIN_' ORDER BY tag) AS name
FROM tags WHERE tag <> own_p || CASE WHEN col = 's' THEN '_TRPS' ELSE '_TRPO' END
GROUP BY query_id, pattern_id, col, own_p""",
)

# A fixed workload over the whole triples, with every kind of partner.
WORKLOAD = {
    "minimum": MINIMUM,
    "two": TWO,
    "loop": [("?x", KNOWS, "?x")],
    "chain": [("?o", SHIPPED, "?sup"), ("?sup", NATION, "?n"), ("?n", REGION, "?r")],
    "unbound": [("?o", PLACED, "?c"), ("?c", SEGMENT, "?g"), ("?c", "?p", "?v")],
}
_PROPERTIES = [CONTAINS, SHIPPED, PLACED, STATUS, FOLLOWS, KNOWS, SEGMENT, NATION, REGION, NAME,
               LABEL, SELF]
# (own property, column, partners), worked out by hand from the queries above.
_REDUCTIONS = [
    (PLACED, "s", [(STATUS, "s")]),
    (PLACED, "o", [(NATION, "s")]),
    (NATION, "s", [(PLACED, "o")]),
    (STATUS, "s", [(PLACED, "s")]),
    (KNOWS, "s", [(FOLLOWS, "s")]),
    (KNOWS, "o", [(FOLLOWS, "o")]),
    (FOLLOWS, "s", [(KNOWS, "s")]),
    (FOLLOWS, "o", [(KNOWS, "o")]),
    (KNOWS, "o", [(KNOWS, "s")]),
    (SHIPPED, "o", [(NATION, "s")]),
    (NATION, "s", [(SHIPPED, "o")]),
    (NATION, "o", [(REGION, "s")]),
    (REGION, "s", [(NATION, "o")]),
    (PLACED, "o", [("ANY", "s"), (SEGMENT, "s")]),
    (SEGMENT, "s", [("ANY", "s"), (PLACED, "o")]),
    *[(p, "s", [(PLACED, "o")] + ([(SEGMENT, "s")] if p != SEGMENT else [])) for p in _PROPERTIES],
]


def _tag(p: str, col: str) -> str:
    return f"{p}_TRP{col.upper()}"


def _reduction_name(p: str, col: str, partners) -> str:
    return "_JOIN_".join([_tag(p, col), *sorted(_tag(*partner) for partner in partners)])


def _reduction_sql(p: str, col: str, partners) -> str:
    tests = [
        f"{col} IN (SELECT {c} FROM triples" + (f" WHERE p = '{q}')" if q != "ANY" else ")")
        for q, c in partners
    ]
    test = " AND ".join(tests)
    if col == "o":
        test = f"(o LIKE '\"%' OR ({test}))"
    name = _reduction_name(p, col, partners)
    return f"SELECT '{name}' AS name, s, p, o FROM triples WHERE p = '{p}' AND {test}"


_REDUCTIONS_SQL = "\nUNION ALL\n".join(
    {_reduction_name(*r): _reduction_sql(*r) for r in _REDUCTIONS}.values()
)


def _workload_reductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = tw.pattern_table(spark, WORKLOAD)
    return tw.workload_reductions(_raw_property_store(spark, sf_dir), patterns)


_register("f5_workload_reductions", _workload_reductions, _REDUCTIONS_SQL)


def _stored_reductions(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    def make() -> tuple[str, DataFrame]:
        path, store = scratch_path(spark, "reductions"), _raw_property_store(spark, sf_dir)
        half = _workload_reductions(spark, sf_dir)
        tw.write_reductions(half.where(F.startswith("name", F.lit(PLACED))), path, store)
        return path, tw.write_reductions(half, path, store)

    return _shared("reductions", spark, sf_dir, make)


_register(
    "a6_write_reductions", lambda spark, sf_dir: _stored_reductions(spark, sf_dir)[1],
    f"SELECT name, count(*) AS n_rows FROM ({_REDUCTIONS_SQL}) AS r GROUP BY name",
)
_STORED = (PLACED, "o", [("ANY", "s"), (SEGMENT, "s")])
_register(
    "a7_read_reduction",
    lambda spark, sf_dir: tw.read_reduction(
        spark, _stored_reductions(spark, sf_dir)[0], _reduction_name(*_STORED), encoded=False,
        version=tw.version_of(_raw_property_store(spark, sf_dir))),
    f"SELECT s, p, o FROM ({_reduction_sql(*_STORED)}) AS r",
)
_both("f6_reduced_bgp", MINIMUM, ["o", "c", "n"], _MINIMUM_SQL, reduced=True)
_both("f6_reduced_bgp_cycle", CYCLE, ["x", "y", "n", "z", "o"], _CYCLE_SQL, reduced=True)
_both(
    "f6_reduced_bgp_unbound", [("?o", PLACED, "?c"), ("?c", "?p", "?v")], None,
    f"""SELECT a.s AS o, a.o AS c, b.p AS p, b.o AS v FROM triples a JOIN triples b ON a.o = b.s
WHERE a.p = '{PLACED}'""",
    reduced=True,
)



def _solve_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain of the workload, read from its stored reductions."""
    path, _ = _stored_reductions(spark, sf_dir)
    return tw.reduced_bgp(_raw_property_store(spark, sf_dir), WORKLOAD["chain"], stored=path)


_CHAIN_SQL = f"""SELECT a.s AS o, a.o AS sup, b.o AS n, r.o AS r FROM triples a JOIN triples b ON b.s = a.o
JOIN triples r ON r.s = b.o AND r.p = '{REGION}' WHERE a.p = '{SHIPPED}' AND b.p = '{NATION}'"""
_register("f6_reduced_bgp_stored", _solve_stored, _CHAIN_SQL)


def _refresh_reductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain from reductions that were stored before and after half of the triples came."""
    path, folder = scratch_path(spark, "reductions"), scratch_path(spark, "growing")
    patterns = tw.pattern_table(spark, {"chain": WORKLOAD["chain"]})
    raw = _raw(spark, sf_dir)
    for rows in (raw.where(F.pmod(F.xxhash64("s"), F.lit(2)) == 0), raw):
        tw.write_properties(rows, folder)
        store = tw.PropertyStore(spark, folder, encoded=False)
        tw.write_reductions(tw.workload_reductions(store, patterns), path, store)
    return tw.reduced_bgp(store, WORKLOAD["chain"], stored=path)


_register("a6_refresh_reductions", _refresh_reductions, _CHAIN_SQL)

# ---------------------------------------------------------------- membership filters


def _side(spark: SparkSession, sf_dir: str, prop: str, side: str) -> DataFrame:
    rows = _store(spark, sf_dir).where(F.col("p") == _id(spark, sf_dir, prop))
    return rows.select(F.col("o_id" if side == "o" else "s").alias("id"))


def _words(ids_sql: str, by: str = "") -> str:
    """64-bit words of an exact filter, as signed numbers."""
    return f"""SELECT {by}bucket,
  CAST(CASE WHEN w >= 9223372036854775808 THEN w - 18446744073709551616 ELSE w END AS BIGINT) AS bits
FROM (SELECT {by}id // 64 AS bucket, bit_or(CAST(1 AS HUGEINT) << CAST(id % 64 AS INTEGER)) AS w
  FROM ({ids_sql}) AS ids WHERE id IS NOT NULL GROUP BY {by}bucket) AS words"""


def _ids_sql(prop: str, column: str) -> str:
    return f"SELECT {column} AS id FROM enc WHERE p = (SELECT id FROM dict WHERE term = '{prop}')"


def _exact_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tw.build_exact_filter(_side(spark, sf_dir, PLACED, "o"))


def _in_filter(spark: SparkSession, sf_dir: str, probe, build) -> DataFrame:
    """Triples whose object is a subject of non-loop `knows`, by a filter."""
    store = _store(spark, sf_dir)
    knows = store.where((F.col("p") == _id(spark, sf_dir, KNOWS)) & (F.col("s") != F.col("o_id")))
    ids = knows.select(F.col("s").alias("key"))
    found = probe(store, "o_id", build(ids))
    return tw.semi_join(found, F.col("o_id"), ids)


_IN_FILTER_SQL = f"""SELECT s, p, o, o_id FROM enc WHERE o_id IN (SELECT s FROM enc
WHERE p = (SELECT id FROM dict WHERE term = '{KNOWS}') AND s <> o_id)"""

_register("g1_build_exact_filter", _exact_filter, _words(_ids_sql(PLACED, "o_id")))


def _bloom_keeps_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _side(spark, sf_dir, PLACED, "s")
    return tw.probe_bloom(ids, "id", tw.build_bloom_filter(ids, 0.01))


_register("g2_build_bloom_filter", _bloom_keeps_all, _ids_sql(PLACED, "s"))


def _probe_exact_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir)
    knows = store.where((F.col("p") == _id(spark, sf_dir, KNOWS)) & (F.col("s") != F.col("o_id")))
    return tw.probe_exact(store, "o_id", tw.build_exact_filter(knows.select("s")))


_register("g3_probe_exact", _probe_exact_only, _IN_FILTER_SQL)
_register(
    "g4_probe_bloom",
    lambda spark, sf_dir: _in_filter(
        spark, sf_dir, tw.probe_bloom, lambda ids: tw.build_bloom_filter(ids, 0.01)),
    _IN_FILTER_SQL,
)
_register(
    "g5_union_filters",
    lambda spark, sf_dir: tw.union_filters(
        _exact_filter(spark, sf_dir),
        tw.build_exact_filter(_side(spark, sf_dir, SHIPPED, "o"))),
    _words(f"{_ids_sql(PLACED, 'o_id')} UNION ALL {_ids_sql(SHIPPED, 'o_id')}"),
)
_register(
    "g6_build_all_filters", _filters,
    _words(
        "SELECT p, 's' AS col, s AS id FROM enc UNION ALL SELECT p, 'o' AS col, o_id AS id FROM enc",
        by="p, col, "),
)


def _all_bloom_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node against the Bloom filters of its properties: all must pass."""
    store, filters = _store(spark, sf_dir), _filters(spark, sf_dir, "bloom")
    held = [
        tw.candidate_properties(filters, s=_id(spark, sf_dir, term))
        .join(store.where(F.col("s") == _id(spark, sf_dir, term)).select("p").distinct(), "p", "left_semi")
        .select(F.lit(term).alias("term"), "p")
        for term in (customer(0), customer(2), EX + "nation/3", SELF)
    ]
    return tw.union_properties(held)


_register(
    "g6_build_all_filters_bloom", _all_bloom_filters,
    f"""SELECT DISTINCT d.term, e.p FROM enc e JOIN dict d ON d.id = e.s
WHERE d.term IN ('{customer(0)}', '{customer(2)}', '{EX}nation/3', '{SELF}')""",
)


def _rate_row(nodes: DataFrame, members: DataFrame, built: DataFrame) -> DataFrame:
    """Over all nodes: members missed, and whether at most twice the asked rate of others is kept."""
    kept = tw.probe_bloom(nodes, "id", built).withColumn("kept", F.lit(True))
    marked = nodes.join(members.distinct().withColumn("member", F.lit(True)), "id", "left").join(kept, "id", "left")
    member, passed = F.col("member").isNotNull(), F.col("kept").isNotNull()
    return marked.agg(
        F.count_if(member & ~passed).alias("missed"),
        (F.count_if(~member & passed) <= 0.02 * F.count_if(~member)).alias("rate_held"),
    )


def _bloom_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _side(spark, sf_dir, PLACED, "s")
    return _rate_row(_dictionary(spark, sf_dir).select("id"), members, tw.build_bloom_filter(members, 0.01))


def _all_bloom_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for the subject filter of every property that the filters name."""
    filters, nodes = _filters(spark, sf_dir, "bloom"), _dictionary(spark, sf_dir).select("id")
    rows = []
    for prop in _PROPERTIES:
        p = _id(spark, sf_dir, prop)
        own = filters.where((F.col("p") == p) & (F.col("col") == "s")).drop("p", "col")
        rows.append(_rate_row(nodes, _side(spark, sf_dir, prop, "s"), own).withColumn("p", F.lit(prop)))
    return reduce(DataFrame.unionByName, rows)


_register("g2_bloom_rate", _bloom_rate, "SELECT CAST(0 AS BIGINT) AS missed, count(*) > 0 AS rate_held FROM triples")
_register(
    "g6_bloom_rate_all", _all_bloom_rate,
    f"""SELECT p, CAST(0 AS BIGINT) AS missed, count(*) > 0 AS rate_held FROM triples
WHERE p IN ({", ".join(f"'{p}'" for p in _PROPERTIES)}) GROUP BY p""",
)

# ---------------------------------------------------------------- candidates


def _candidates(s=None, o=None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ids = {name: _id(spark, sf_dir, term) for name, term in (("s", s), ("o", o)) if term}
        return tw.candidate_properties(_filters(spark, sf_dir), **ids)

    return run


_HOLDS_S = f"SELECT p FROM enc WHERE s = (SELECT id FROM dict WHERE term = '{customer(2)}')"
_HOLDS_O = f"SELECT p FROM enc WHERE o_id = (SELECT id FROM dict WHERE term = '{customer(14)}')"
_register(
    "h1_candidate_properties", _candidates(customer(2), customer(14)),
    f"{_HOLDS_S} INTERSECT {_HOLDS_O}",
)
_register("h1_candidate_properties_s", _candidates(customer(2)), f"SELECT DISTINCT p FROM ({_HOLDS_S}) AS r")
_register("h1_candidate_properties_all", _candidates(), "SELECT DISTINCT p FROM enc")


def _verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, o = _id(spark, sf_dir, customer(2)), _id(spark, sf_dir, customer(14))
    candidates = tw.candidate_properties(_filters(spark, sf_dir), s, o)
    return tw.verify_properties(_property_store(spark, sf_dir), candidates, s, o)


_register(
    "h2_verify_properties", _verified,
    f"""SELECT DISTINCT p FROM enc WHERE s = (SELECT id FROM dict WHERE term = '{customer(2)}')
AND o_id = (SELECT id FROM dict WHERE term = '{customer(14)}')""",
)


def _created_store(spark: SparkSession, sf_dir: str) -> tw.PropertyStore:
    return _shared(
        "created", spark, sf_dir,
        lambda: tw.create_store(star_triples(spark, sf_dir), scratch_path(spark, "created")),
    )


def _by_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All triples between two customers, from the properties that the filters leave."""
    store = _created_store(spark, sf_dir)
    patterns = tw.encode_query([(customer(2), "?p", "?x"), ("?x", "?q", customer(14))], store.dictionary)
    return tw.decode_bindings(tw.bgp(store, patterns), store.dictionary)


def _on_created(patterns, solve, **options) -> Query:
    """A query on the store written in one call, whose filters stand for partner columns."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = _created_store(spark, sf_dir)
        found = solve(store, tw.encode_query(patterns, store.dictionary), **options)
        return tw.decode_bindings(found, store.dictionary)

    return run


_register("f6_reduced_bgp_by_filters", _on_created(CYCLE, tw.reduced_bgp), _CYCLE_SQL)
_register("f6_reduced_star_by_filters", _on_created(STAR, tw.reduced_bgp), _STAR_SQL)
_register(
    "f6_reduced_unbound_by_filters", _on_created([("?o", PLACED, "?c"), ("?c", "?p", "?v")], tw.reduced_bgp),
    f"""SELECT a.s AS o, a.o AS c, b.p AS p, b.o AS v FROM triples a JOIN triples b ON a.o = b.s
WHERE a.p = '{PLACED}'""",
)


def _of_property(prop: str) -> str:
    return f"FROM enc WHERE p = (SELECT id FROM dict WHERE term = '{prop}')"


def _reduce_by_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _created_store(spark, sf_dir)
    encoded = tw.encode_query(CYCLE, store.dictionary)
    return tw.reduce_pattern(store, encoded[0], encoded)


_register(
    "f3_reduce_pattern_by_filters", _reduce_by_filters,
    f"""SELECT s, p, o, o_id {_of_property(KNOWS)} AND s IN (SELECT s {_of_property(NATION)})
AND s IN (SELECT o_id {_of_property(PLACED)}) AND o_id IN (SELECT s {_of_property(FOLLOWS)})""",
)
_register(
    "f2_reduce_object_enc",
    _on_store(lambda t: tw.reduce_object(t, [t.where("s = o_id").select("s"), t.select("o_id").where("o_id IS NOT NULL")])),
    "SELECT s, p, o, o_id FROM enc WHERE o_id IS NULL OR o_id IN (SELECT s FROM enc WHERE s = o_id)",
)


def _reduction_enc_sql(p: str, col: str, partners) -> str:
    def tag(prop: str, side: str) -> str:
        name = "'ANY'" if prop == "ANY" else f"CAST((SELECT id FROM dict WHERE term = '{prop}') AS VARCHAR)"
        return f"{name} || '_TRP{side.upper()}'"

    key = {"s": "s", "o": "o_id"}
    tests = " AND ".join(
        f"{key[col]} IN (SELECT {key[c]} " + ("FROM enc)" if q == "ANY" else f"{_of_property(q)} AND {key[c]} IS NOT NULL)")
        for q, c in partners)
    if col == "o":
        tests = f"(o_id IS NULL OR ({tests}))"
    tags = ", ".join(tag(*partner) for partner in partners)
    name = f"{tag(p, col)} || '_JOIN_' || array_to_string(list_sort([{tags}]), '_JOIN_')"
    return f"SELECT {name} AS name, s, p, o, o_id {_of_property(p)} AND {tests}"


def _reductions_by_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _created_store(spark, sf_dir)
    patterns = tw.encode_patterns(tw.pattern_table(spark, WORKLOAD), store.dictionary)
    return tw.workload_reductions(store, patterns.drop("matched"))


_register(
    "f5_workload_reductions_by_filters", _reductions_by_filters,
    "\nUNION ALL\n".join({_reduction_name(*r): _reduction_enc_sql(*r) for r in _REDUCTIONS}.values()),
)

# Nothing is placed by a region: both reductions are empty.
NOTHING = [("?n", REGION, "?r"), ("?r", PLACED, "?c")]
_NO_ROWS = {_reduction_name(*r): _reduction_sql(*r) for r in [(REGION, "o", [(PLACED, "s")]), (PLACED, "s", [(REGION, "o")])]}


def _grown_workload(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """Reductions of one query, then of a workload with that query in it."""
    def make() -> tuple[str, DataFrame]:
        path, store = scratch_path(spark, "reductions"), _raw_property_store(spark, sf_dir)
        tw.write_workload(store, tw.pattern_table(spark, {"chain": WORKLOAD["chain"]}), path)
        return path, tw.write_workload(store, tw.pattern_table(spark, WORKLOAD | {"nothing": NOTHING}), path)

    return _shared("workload", spark, sf_dir, make)


_register(
    "a6_write_workload", lambda spark, sf_dir: _grown_workload(spark, sf_dir)[1],
    f"""SELECT name, count(s) AS n_rows FROM (
  {_REDUCTIONS_SQL}
UNION ALL
  {" UNION ALL ".join(_NO_ROWS.values())}
UNION ALL
  SELECT unnest([{", ".join(f"'{name}'" for name in [*dict.fromkeys(_reduction_name(*r) for r in _REDUCTIONS), *_NO_ROWS])}]), NULL, NULL, NULL
) AS r GROUP BY name""",
)


def _empty_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solutions of a query with a reduction that is known to be empty, and of one without."""
    path, _ = _grown_workload(spark, sf_dir)
    store = _raw_property_store(spark, sf_dir)
    counted = [
        tw.count_results(tw.reduced_bgp(store, patterns, stored=path)).withColumn("query_id", F.lit(query_id))
        for query_id, patterns in (("nothing", NOTHING), ("chain", WORKLOAD["chain"]))
    ]
    return reduce(DataFrame.unionByName, counted)


_register(
    "a6_empty_reduction", _empty_reduction,
    f"""SELECT 'nothing' AS query_id, count(*) AS n_results FROM triples a JOIN triples b ON b.s = a.o
WHERE a.p = '{REGION}' AND b.p = '{PLACED}'
UNION ALL SELECT 'chain', count(*) FROM ({_CHAIN_SQL}) AS r""",
)
_register(
    "h1_workload_candidates",
    lambda spark, sf_dir: tw.workload_candidates(
        _filters(spark, sf_dir), tw.encode_patterns(_workload(spark, sf_dir), _dictionary(spark, sf_dir))),
    f""", w AS ({_WORKLOAD_SQL})
SELECT DISTINCT w.query_id, w.pattern_id, e.p FROM w JOIN dict d ON d.term = w.s JOIN enc e ON e.s = d.id
WHERE w.p LIKE '?%' AND w.o LIKE '?%'""",
)


def _bucketed_store(spark: SparkSession, sf_dir: str) -> tw.PropertyStore:
    """The encoded triples with every property dealt to the same buckets of subjects."""
    def make() -> tw.PropertyStore:
        path = scratch_path(spark, "bucketed")
        tw.write_properties(_store(spark, sf_dir), path, n_buckets=8)
        return tw.PropertyStore(spark, path)

    return _shared("bucketed", spark, sf_dir, make)


def _bucketed_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    dictionary = _dictionary(spark, sf_dir)
    return tw.decode_bindings(tw.bgp(_bucketed_store(spark, sf_dir), tw.encode_query(STAR, dictionary)), dictionary)


_register("a4_write_buckets", lambda spark, sf_dir: _bucketed_store(spark, sf_dir).table, "SELECT s, p, o, o_id FROM enc")
_register("k1_bucketed_star", _bucketed_star, _STAR_SQL)
_STATS_SQL = """SELECT p, count(*) AS n,
  CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM triples) AS ratio,
  count(DISTINCT s) AS n_s, count(DISTINCT o) AS n_o FROM {table} GROUP BY p"""
_register(
    "a4_create_store", lambda spark, sf_dir: _created_store(spark, sf_dir).table,
    "SELECT s, p, o, o_id FROM enc",
)
_register(
    "a4_create_store_stats", lambda spark, sf_dir: _created_store(spark, sf_dir).stats,
    _STATS_SQL.format(table="enc"),
)
_register(
    "d6_unbound_by_filters", _by_filters,
    f"""SELECT a.p AS p, a.o AS x, b.p AS q FROM triples a JOIN triples b ON a.o = b.s
WHERE a.s = '{customer(2)}' AND b.o = '{customer(14)}'""",
)

# ---------------------------------------------------------------- counts, sets, layout

_register(
    "i1_dataset_stats", _on_raw(tw.dataset_stats),
    "SELECT count(*) AS n_triples, count(DISTINCT p) AS n_properties FROM triples",
)
_register("i2_property_stats", _on_raw(tw.property_stats), _STATS_SQL.format(table="triples"))
_register("i2_property_stats_enc", _on_store(tw.property_stats), _STATS_SQL.format(table="enc"))
_register(
    "i3_distinct_terms", _on_raw(lambda t: tw.distinct_terms(t, "o")),
    "SELECT DISTINCT o FROM triples",
)
_register(
    "i3_distinct_terms_by_property", _on_raw(lambda t: tw.distinct_terms(t, "s", by_property=True)),
    "SELECT DISTINCT p, s FROM triples",
)
_register(
    "i4_count_results", _on_raw(lambda t: tw.count_results(tw.bgp(t, CYCLE))),
    f"SELECT count(*) AS n_results FROM ({_CYCLE_SQL}) AS r",
)


def _rows(prop: str, test: str = "TRUE") -> str:
    return f"(SELECT count(*) FROM triples WHERE p = '{prop}' AND {test})"


def _occurs(column: str, prop: str, other: str) -> str:
    return f"{column} IN (SELECT {other} FROM triples WHERE p = '{prop}')"


REPORT = {"minimum": MINIMUM, "two": TWO, "unbound": UNBOUND}
_READ = f"t.p IN (SELECT p FROM triples WHERE s = '{customer(2)}')"
_register(
    "i5_workload_report", _on_raw(lambda t: tw.workload_report(t, REPORT)),
    f"""SELECT 'minimum' AS query_id, (SELECT count(*) FROM ({_MINIMUM_SQL}) AS r) AS n_results,
  {_rows(PLACED)} + {_rows(NATION)} + {_rows(STATUS)} AS original_rows,
  {_rows(PLACED, _occurs("s", STATUS, "s") + " AND " + _occurs("o", NATION, "s"))}
  + {_rows(NATION, _occurs("s", PLACED, "o"))} + {_rows(STATUS, _occurs("s", PLACED, "s"))} AS reduced_rows,
  CAST(2 AS BIGINT) AS max_joins, CAST(3 AS BIGINT) AS n_patterns
UNION ALL
SELECT 'two', (SELECT count(*) FROM ({_TWO_SQL}) AS r), {_rows(KNOWS)} + {_rows(FOLLOWS)},
  {_rows(KNOWS, _occurs("s", FOLLOWS, "s") + " AND " + _occurs("o", FOLLOWS, "o"))}
  + {_rows(FOLLOWS, _occurs("s", KNOWS, "s") + " AND " + _occurs("o", KNOWS, "o"))}, 2, 2
UNION ALL
SELECT 'unbound', (SELECT count(*) FROM triples a JOIN triples b ON a.o = b.o
    WHERE a.s = '{customer(2)}' AND b.s = '{customer(2)}' AND b.p = '{FOLLOWS}'),
  (SELECT count(*) FROM triples t WHERE {_READ}) + {_rows(FOLLOWS)},
  (SELECT count(*) FROM triples t WHERE {_READ} AND (o LIKE '"%' OR {_occurs("o", FOLLOWS, "o")}))
  + {_rows(FOLLOWS, "o IN (SELECT o FROM triples)")}, 2, 2""",
)
_register(
    "j1_union_properties",
    _on_raw(
        lambda t: tw.union_properties([t.where(F.col("p") == p) for p in (PLACED, STATUS, SHIPPED)])
    ),
    f"SELECT s, p, o FROM triples WHERE p IN ('{PLACED}', '{STATUS}', '{SHIPPED}')",
)
_register(
    "j2_intersect_properties",
    _on_raw(
        lambda t: tw.intersect_properties(
            t.where(F.startswith("o", F.lit(EX + "customer/"))),
            t.where(F.startswith("s", F.lit(EX + "customer/"))))
    ),
    f"""SELECT p FROM triples WHERE o LIKE '{EX}customer/%'
INTERSECT SELECT p FROM triples WHERE s LIKE '{EX}customer/%'""",
)
_register("k1_partition_by", _on_raw(lambda t: tw.partition_by(t, "s")), "SELECT s, p, o FROM triples")
_register("k1_partition_by_object", _on_raw(lambda t: tw.partition_by(t, "o")), "SELECT s, p, o FROM triples")


# ---------------------------------------------------------------- contract


def entry(spark: SparkSession) -> DataFrame:
    """Orders with status F, their customers and the customers' nations."""
    return _QUERIES["d7_bgp_minimum"](spark, "/root/testdata/sf0.001")


try:  # the corpus operators are a subpackage of their own, which may be left out
    import corpus_pipeline
    from tripleweft.llm.queries import ORACLES, QUERIES
except ImportError:
    pass
else:
    _QUERIES |= QUERIES | {"pipeline": corpus_pipeline.run}
    _ORACLES |= ORACLES
    if corpus_pipeline.ORACLE_SQL:
        _ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL


def queries() -> dict[str, Query]:
    """One entry per operator; each takes (spark, sf_dir)."""
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """The same results as SQL over the given tables."""
    return dict(_ORACLES)
