"""Stores written in one call, filters in the query path, reductions tied to their triples."""

import pytest
from tests.conftest import SAMPLE, bag, iri

import tripleweft as tw
from tripleweft import session
from tripleweft.sources.reductions import read_catalog

QUERIES = [
    [("?x", "?p", "Bo")],
    [("Ada", "?p", "?x"), ("?x", "?q", "Cy")],
    [("Di", "?p", "?x"), ("?x", "paints", "?w")],
    [("Eve", "?p", "?x"), ("?x", "title", "?t")],
    [("?x", "?p", "Nobody")],
]


def named(patterns):
    return [tuple(iri(term) for term in pattern) for pattern in patterns]


@pytest.fixture(scope="module", params=["exact", "bloom"])
def store(request, sample, tmp_path_factory):
    return tw.create_store(sample, str(tmp_path_factory.mktemp("store")), request.param)


def test_a_created_store_holds_everything(store, sample):
    assert bag(store.dictionary) == bag(tw.build_dictionary(sample))
    assert bag(store.table) == bag(tw.encode_triples(sample, store.dictionary))
    assert bag(store.stats) == bag(tw.property_stats(store.table))
    assert tw.open_store(store.sparkSession, store.path.removesuffix("/triples")).filters.count() == store.filters.count()


@pytest.mark.parametrize("patterns", QUERIES)
def test_filters_change_no_answer(store, sample, patterns):
    expected = bag(tw.bgp(sample, named(patterns)))
    encoded = tw.encode_query(named(patterns), store.dictionary)
    for solve in (tw.bgp, tw.reduced_bgp):
        found = solve(store, encoded)
        assert bag(tw.decode_bindings(found, store.dictionary).select(*found.columns)) == expected


def test_only_found_properties_are_opened(store):
    pattern, = tw.encode_query([(iri("Di"), "?p", "?x")], store.dictionary)
    ids = {r["term"]: r["id"] for r in store.dictionary.collect()}
    files = tw.candidate_rows(store, pattern).inputFiles()
    opened = {int(f.split("/p=")[1].split("/")[0]) for f in files}
    held = {ids[iri(p)] for s, p, _ in SAMPLE if s == "Di"}
    assert held <= opened < {ids[iri(p)] for _, p, _ in SAMPLE}


def test_reductions_of_older_triples_are_not_served(spark, sample, tmp_path):
    path, folder = str(tmp_path / "reductions"), str(tmp_path / "store")
    patterns = named([("?a", "paints", "?w"), ("?w", "hangsIn", "?h")])
    workload = tw.pattern_table(spark, {"q": patterns})
    tw.write_properties(sample.where(sample.s != iri("Ada")), folder)
    old = tw.PropertyStore(spark, folder, encoded=False)
    first = tw.version_of(old)
    tw.write_reductions(tw.workload_reductions(old, workload), path, old)
    sizes = bag(read_catalog(spark, path, first))
    assert sizes

    added = sample.where(sample.s == iri("Ada")).select("s", "o", "p")
    added.write.mode("append").partitionBy("p").parquet(folder)
    grown = tw.PropertyStore(spark, folder, encoded=False)
    second = tw.version_of(grown)
    assert second != first and read_catalog(spark, path, second).isEmpty()
    expected = bag(tw.bgp(sample, patterns))
    assert bag(tw.reduced_bgp(grown, patterns, stored=path)) == expected  # computed

    tw.write_reductions(tw.workload_reductions(grown, workload), path, grown)
    assert bag(read_catalog(spark, path, second)) != sizes
    assert bag(read_catalog(spark, path, first)) == sizes
    names = tw.reduction_names(patterns[0], patterns).values()
    assert tw.read_stored(spark, path, names, encoded=False, version=second)
    assert bag(tw.reduced_bgp(grown, patterns, stored=path)) == expected  # read


def test_broadcasts_are_bounded_by_bytes(spark, monkeypatch):
    few = spark.range(10).selectExpr("id", "repeat('x', 100) AS name")

    def hinted(df):
        return "strategy=broadcast" in df._jdf.queryExecution().analyzed().toString()

    assert hinted(session.broadcast_if_small(few))
    monkeypatch.setattr(session, "BROADCAST_BYTES", 1000)
    assert not hinted(session.broadcast_if_small(few))
    assert hinted(session.broadcast_if_small(few.select("id")))
    assert not hinted(session.broadcast_if_small(few.select("id"), 9))
