"""Queries and statistics of the sample graph, solved by hand, raw and encoded."""

import pytest

import tripleweft as tw
from tests.conftest import bag, iri


def p(*names):
    return tuple(iri(n) for n in names)


QUERIES = {
    "star": ([p("?s", "paints", "?w"), p("?s", "admires", "?a"), p("?s", "born", "?y"),
              p("?s", "teaches", "Bo")], ["s", "w", "a", "y"],
             [("Ada", "Dawn", "Bo", '"1901"'), ("Ada", "Dawn", "Di", '"1901"')]),
    "two": ([p("?x", "teaches", "?y"), p("?x", "admires", "?y")], ["x", "y"],
            [("Ada", "Bo"), ("Bo", "Cy")]),
    "unbound": ([p("Bo", "?p", "?o"), p("Bo", "admires", "?o")], ["p", "o"],
                [("admires", "Cy"), ("teaches", "Cy")]),
    "loop": ([p("?x", "teaches", "?x")], ["x"], [("Cy",)]),
    "any": ([p("?s", "?p", "?s")], None, [("Cy", "teaches")]),
}


@pytest.mark.parametrize("solve", [tw.bgp, tw.reduced_bgp])
@pytest.mark.parametrize("name", list(QUERIES))
def test_raw(name, solve, sample):
    patterns, select, expected = QUERIES[name]
    assert bag(solve(sample, patterns, select)) == [tuple(map(iri, row)) for row in expected]


@pytest.mark.parametrize("solve", [tw.bgp, tw.reduced_bgp])
@pytest.mark.parametrize("name", list(QUERIES))
def test_encoded(name, solve, sample_enc, sample_dictionary):
    patterns, select, expected = QUERIES[name]
    found = solve(sample_enc, tw.encode_query(patterns, sample_dictionary), select)
    decoded = tw.decode_bindings(found, sample_dictionary)
    assert bag(decoded) == [tuple(map(iri, row)) for row in expected]


def test_property_statistics(sample, sample_enc, sample_dictionary):
    counts = {
        "admires": (5, 3, 5), "born": (3, 3, 3), "hangsIn": (3, 3, 2), "owns": (3, 2, 3),
        "paints": (3, 2, 3), "teaches": (4, 4, 2), "title": (3, 3, 3),
    }
    expected = {name: (n, n / 24, n_s, n_o) for name, (n, n_s, n_o) in counts.items()}
    rows = bag(tw.property_stats(sample))
    assert rows == sorted(((iri(n), *v) for n, v in expected.items()), key=repr)
    encoded = tw.decode_bindings(tw.property_stats(sample_enc), sample_dictionary, ["p"])
    assert bag(encoded) == rows
    assert bag(tw.dataset_stats(sample)) == [(24, 7)]


def test_dictionary_has_seventeen_terms(sample_dictionary):
    rows = bag(sample_dictionary.select("id", "term"))
    assert [r[0] for r in sorted(rows)] == list(range(1, 18))
    assert [r[1] for r in sorted(rows)] == sorted(r[1] for r in rows)


def test_reduction_of_disjoint_columns_is_empty(sample):
    paints = tw.read_pattern(sample, p("?a", "paints", "?b"))
    assert tw.reduce_object(paints, [tw.partner_keys(sample, (iri("paints"), "s"))]).isEmpty()


def test_unbound_partner_keeps_all_that_can_join(sample):
    """`?a paints ?z . ?z ?p ?b`: the objects are subjects of other properties."""
    patterns = [p("?a", "paints", "?z"), p("?z", "?p", "?b")]
    assert tw.reduce_pattern(sample, patterns[0], patterns).count() == 3
    assert bag(tw.reduced_bgp(sample, patterns)) == bag(tw.bgp(sample, patterns))


def test_reduction_names(spark, sample):
    queries = {
        "path": [("?a", "5", "?b"), ("?b", "?p", "?c")],
        "ring": [("?a", "8", "?a")],
        "fan": [("?a", "5", "?b"), ("?a", "6", "?c"), ("?a", "8", "3"), ("?a", "6", "?c")],
        "single": [("?a", "5", "?b")],
    }
    rows = bag(tw.reduction_keys(tw.pattern_table(spark, queries)))
    assert rows == sorted([
        ("path", 0, "o", "5_TRPO_JOIN_ANY_TRPS"),
        ("path", 1, "s", "ANY_TRPS_JOIN_5_TRPO"),
        ("ring", 0, "o", "8_TRPO_JOIN_8_TRPS"),
        ("fan", 0, "s", "5_TRPS_JOIN_6_TRPS_JOIN_8_TRPS"),
        ("fan", 1, "s", "6_TRPS_JOIN_5_TRPS_JOIN_8_TRPS"),
        ("fan", 2, "s", "8_TRPS_JOIN_5_TRPS_JOIN_6_TRPS"),
        ("fan", 3, "s", "6_TRPS_JOIN_5_TRPS_JOIN_8_TRPS"),
    ], key=repr)
    for query_id, pattern_id, col, name in rows:
        pattern = queries[query_id][pattern_id]
        if not pattern[1].startswith("?"):
            assert tw.reduction_names(pattern, queries[query_id])[col] == name
