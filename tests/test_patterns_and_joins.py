"""Pattern shapes against a brute-force matcher, and the joins of bindings."""

import itertools

import pytest

import tripleweft as tw
from tests.conftest import bag
from tripleweft.operators import joins

SCHEMA = "s STRING, p STRING, o STRING"
# Few terms in all positions, a literal, a duplicate: every shape has matches.
TRIPLES = [
    ("a", "a", "a"), ("a", "b", "a"), ("a", "b", "c"), ("b", "c", "c"), ("c", "c", "a"),
    ("a", "a", '"x"'), ("b", "a", '"x"@en'), ("c", "b", "a"), ("a", "b", "c"), ("d", "b", '"10"'),
    ("b", "b", "c"), ("c", "a", "b"),
]
TERMS = {"s": ["?x", "?y", "a"], "p": ["?x", "?y", "?z", "b"], "o": ["?x", "?z", "c", '"x"']}
SHAPES = list(itertools.product(*TERMS.values()))


def solve_by_hand(patterns, triples=TRIPLES):
    solutions = [{}]
    for pattern in patterns:
        found = []
        for binding, triple in itertools.product(solutions, triples):
            new = dict(binding)
            for term, value in zip(pattern, triple):
                if term.startswith("?"):
                    if new.setdefault(term[1:], value) != value:
                        break
                elif term != value:
                    break
            else:
                found.append(new)
        solutions = found
    return solutions


def rows_by_hand(patterns, names):
    return sorted((tuple(b[n] for n in names) for b in solve_by_hand(patterns)), key=repr)


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(TRIPLES, SCHEMA).cache()


@pytest.fixture(scope="module")
def dictionary(raw):
    return tw.build_dictionary(raw).cache()


@pytest.fixture(scope="module")
def enc(raw, dictionary):
    return tw.encode_triples(raw, dictionary).cache()


@pytest.fixture(scope="module")
def terms_by_id(dictionary):
    return {row["id"]: row["term"] for row in dictionary.collect()}


def decoded(df, terms_by_id):
    def term(value):
        return terms_by_id.get(int(value), value) if str(value).isdigit() else value

    return sorted((tuple(term(v) for v in row) for row in df.collect()), key=repr)


@pytest.mark.parametrize("pattern", SHAPES, ids=" ".join)
def test_shape(pattern, raw, enc, dictionary, terms_by_id):
    names = list(dict.fromkeys(t[1:] for t in pattern if t.startswith("?")))
    expected = rows_by_hand([pattern], names)
    found = tw.match_pattern(raw, pattern)
    assert found.columns == names
    encoded = tw.match_pattern(enc, tw.encode_query([pattern], dictionary)[0])
    if names:
        assert bag(found) == expected
        assert decoded(encoded, terms_by_id) == expected
    else:
        assert found.count() == encoded.count() == len(expected)


CONJUNCTIONS = [
    [("?x", "b", "?y"), ("?y", "c", "?z")],
    [("?x", "b", "?y"), ("?z", "?w", "?y")],
    [("?x", "b", "?y"), ("?x", "?p", "?y")],
    [("?x", "?p", "?y"), ("?x", "?p", "?y")],
    [("?x", "?y", "?z"), ("?y", "?z", "?w")],
    [("a", "b", "c"), ("?x", "b", "?y")],
    [("?x", "b", "?y"), ("a", "b", "c"), ("?y", "?p", "?v")],
    [("?x", "b", "?y"), ("a", "b", "unknown")],
    [("?x", "a", "?l"), ("?y", "a", "?l")],
    [("?x", "?p", "?x"), ("?x", "?q", "?v"), ("?v", "?q", "?w")],
    [("?x", "b", "?y"), ("?y", "?y", "?x"), ("?x", "a", '"x"')],
    [("?x", "?x", "?o"), ("?s", "?x", "?x")],
]


@pytest.mark.parametrize("patterns", CONJUNCTIONS, ids=str)
def test_conjunction(patterns, raw, enc, dictionary, terms_by_id):
    names = list(dict.fromkeys(t[1:] for q in patterns for t in q if t.startswith("?")))
    expected = rows_by_hand(patterns, names)
    encoded = tw.encode_query(patterns, dictionary)
    for solve in (tw.bgp, tw.reduced_bgp):
        found = solve(raw, patterns)
        assert found.columns == names and bag(found) == expected
        assert decoded(solve(enc, encoded), terms_by_id) == expected


def test_only_fully_bound_patterns(raw):
    twice, once = ("a", "b", "c"), ("b", "c", "c")
    assert tw.bgp(raw, [twice, once, twice]).count() == 4
    assert tw.bgp(raw, [twice, ("x", "b", "c")]).count() == 0


def test_repeating_rows_beyond_one_block(spark, raw):
    from tripleweft.operators import joins

    many = spark.range(joins._REPEAT_BLOCK * 2 + 5).select()
    one = raw.limit(1).select("s")
    assert tw.join_bindings(one, many).count() == joins._REPEAT_BLOCK * 2 + 5


def test_product_must_be_asked_for(raw):
    patterns = [("?x", "b", "?y"), ("?v", "c", "?w")]
    with pytest.raises(ValueError, match="allow_product"):
        tw.bgp(raw, patterns)
    found = tw.bgp(raw, patterns, allow_product=True)
    assert bag(found) == rows_by_hand(patterns, found.columns)


def test_projection_keeps_duplicates_and_order(raw):
    found = tw.bgp(raw, [("?x", "b", "?y")], ["?y", "?x"])
    assert found.columns == ["y", "x"]
    assert bag(found) == rows_by_hand([("?x", "b", "?y")], ["y", "x"])


def test_unbound_property_with_candidates(spark, raw):
    bindings = tw.match_pattern(raw, ("?x", "b", "?y"))
    only = spark.createDataFrame([("c",), ("c",)], "p STRING")
    found = tw.join_unbound_property(raw, ("?y", "?p", "?v"), bindings, only)
    expected = [b for b in solve_by_hand([("?x", "b", "?y"), ("?y", "?p", "?v")]) if b["p"] == "c"]
    assert bag(found.select("x", "y", "p", "v")) == sorted(
        (tuple(b[n] for n in "xypv") for b in expected), key=repr)


def test_joins_on_encoded_literals_and_ids(spark):
    triples = spark.createDataFrame(
        [("a", "p", "b"), ("a", "p", '"text"'), ("b", "q", "c")], "s STRING, p STRING, o STRING")
    dictionary = tw.build_dictionary(triples)
    enc = tw.encode_triples(triples, dictionary)
    left, right = tw.encode_query([("?a", "p", "?x"), ("?x", "q", "?n")], dictionary)
    found = tw.join_bindings(tw.match_pattern(enc, left), tw.match_pattern(enc, right))
    assert bag(tw.decode_bindings(found, dictionary, ["a", "x", "n"]).select("a", "x", "n")) == [("a", "b", "c")]
    other = tw.join_unbound_property(enc, ("?x", "?y", "?n"), tw.match_pattern(enc, left))
    assert bag(tw.decode_bindings(other, dictionary).select("x", "y", "n")) == [("b", "q", "c")]


@pytest.mark.parametrize("flipped", [False, True])
def test_a_product_sends_its_small_side_to_the_other_one(spark, flipped):
    """Whatever Spark thinks of the sizes: it would read one side once per task of the other."""
    few, many = spark.range(3).toDF("a"), spark.range(200).toDF("b")
    key = "spark.sql.autoBroadcastJoinThreshold"
    before, kept = spark.conf.get(key), joins.is_small
    spark.conf.set(key, "-1")
    try:
        joins.is_small = lambda df: kept(df, 10)
        both = tw.join_bindings(*((few, many) if flipped else (many, few)), allow_product=True)
    finally:
        joins.is_small = kept
    try:
        plan = both._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastNestedLoopJoin" in plan and "CartesianProduct" not in plan
        assert bag(both.select("a", "b")) == bag(few.crossJoin(many))
    finally:
        spark.conf.set(key, before)
