"""A whole workload in one pass, against each query on its own."""

import pytest

import tripleweft as tw
from tests.test_stored_filters import QUERIES, named
from tripleweft.plans import workload

MORE = [
    [("?x", "teaches", "?y"), ("?y", "teaches", "?z"), ("?z", "?p", "?z")],
    [("Ada", "teaches", "Bo"), ("?x", "paints", "?w"), ("?x", "paints", "?w")],
    [("?a", "hangsIn", "?b"), ("?c", "hangsIn", "?b")],
    [("?x", "title", '"Noon"'), ("?x", "?p", '"Noon"')],
    [("?s", "?p", "?o")],
    [("Nobody", "?p", "?o"), ("?o", "born", "?b")],
]


@pytest.fixture(scope="module", params=["raw", "encoded", "filters"])
def source(request, sample, sample_enc, sample_dictionary, tmp_path_factory):
    if request.param == "raw":
        return sample, lambda q: named(q)
    if request.param == "encoded":
        return sample_enc, lambda q: tw.encode_query(named(q), sample_dictionary)
    store = tw.create_store(sample, str(tmp_path_factory.mktemp("store")))
    return store, lambda q: tw.encode_query(named(q), store.dictionary)


def test_report_equals_single_queries(source):
    triples, translate = source
    queries = {f"q{i}": translate(q) for i, q in enumerate(QUERIES + MORE)}
    report = {r["query_id"]: r for r in tw.workload_report(triples, queries).collect()}
    assert set(report) == set(queries)
    for name, patterns in queries.items():
        assert report[name]["n_results"] == tw.bgp(triples, patterns).count()
        assert report[name]["original_rows"] == sum(tw.read_pattern(triples, q).count() for q in patterns)
        assert report[name]["reduced_rows"] == sum(tw.reduce_pattern(triples, q, patterns).count() for q in patterns)


def test_plan_does_not_grow_with_the_queries(sample):
    def size(n: int) -> int:
        queries = {f"q{i}": named(QUERIES[2]) for i in range(n)}
        return tw.workload_report(sample, queries)._jdf.queryExecution().optimizedPlan().toString().count("\n")

    assert size(12) == size(2)


def test_products_are_refused_unless_asked_for(sample):
    query = {"q": named([("?x", "born", "?b"), ("?y", "owns", "?w")])}
    with pytest.raises(ValueError, match="shares no variable"):
        tw.workload_report(sample, query)
    assert tw.count_solutions(sample, query, allow_product=True).first()["n_results"] == 9
    assert workload.join_order(named(QUERIES[3]))[0] == named(QUERIES[3])[1]
