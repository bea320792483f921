"""Bucketed stores, reductions by stored filters, and probes that do not move the probed table."""

from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

import tripleweft as tw
from tests.conftest import SAMPLE, R, bag, iri
from tests.test_reductions_and_filters import executed_plan
from tripleweft.operators import filters as filter_operators
from tripleweft.sources import properties

STAR = [("?x", "paints", "?w"), ("?x", "born", "?y"), ("?x", "teaches", "?z")]
QUERIES = [
    STAR,
    [("?x", "teaches", "?x")],
    [("?x", "admires", "?y"), ("?y", "paints", "?w"), ("?w", "hangsIn", "?h")],
    [("?x", "paints", "?w"), ("?w", "hangsIn", "East"), ("?x", "born", "?b")],
    [("?x", "?p", "?x"), ("?y", "teaches", "?x")],
    [("?x", "owns", "?w"), ("?w", "?p", "?v")],
    [("?x", "hangsIn", "?y"), ("?y", "paints", "?z")],
    [("Di", "?p", "?x"), ("?x", "title", "?t")],
]


def named(patterns):
    return [tuple(iri(term) for term in pattern) for pattern in patterns]


@pytest.fixture(scope="module")
def store(sample, tmp_path_factory):
    return tw.create_store(sample, str(tmp_path_factory.mktemp("store")))


@pytest.fixture
def shuffled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def solved(store, patterns, solve, **options):
    found = solve(store, tw.encode_query(named(patterns), store.dictionary), **options)
    return bag(tw.decode_bindings(found, store.dictionary).select(*found.columns))


@pytest.mark.parametrize("patterns", QUERIES)
def test_reduction_by_filters_changes_no_answer(store, sample, patterns):
    expected = bag(tw.bgp(sample, named(patterns)))
    assert solved(store, patterns, tw.bgp) == solved(store, patterns, tw.reduced_bgp) == expected


@pytest.mark.parametrize("patterns", QUERIES)
def test_filters_and_partner_columns_give_the_same_reductions(store, patterns):
    encoded = tw.encode_query(named(patterns), store.dictionary)
    plain = tw.PropertyStore(store.sparkSession, store.path)
    for pattern in encoded:
        assert bag(tw.reduce_pattern(store, pattern, encoded)) == bag(tw.reduce_pattern(plain, pattern, encoded))
    workload = tw.pattern_table(store.sparkSession, {"q": encoded})
    assert bag(tw.workload_reductions(store, workload)) == bag(tw.workload_reductions(plain, workload))


def test_partner_columns_are_not_read(store):
    encoded = tw.encode_query(named(QUERIES[2]), store.dictionary)
    files = tw.reduce_pattern(store, encoded[0], encoded).inputFiles()
    assert {f.split("/triples/")[1].split("/")[0] for f in files if "/triples/" in f} == {f"p={encoded[0][1]}"}


def test_filters_of_other_files_are_not_used(sample, tmp_path):
    path = str(tmp_path / "store")
    store = tw.create_store(sample.where(F.col("s") != iri("Ada")), path)
    assert tw.open_store(store.sparkSession, path).filters is not None
    more = tw.encode_triples(sample.where(F.col("s") == iri("Ada")), tw.build_dictionary(sample))
    more.write.mode("append").partitionBy("p").parquet(f"{path}/triples")
    assert tw.open_store(store.sparkSession, path).filters is None


def test_object_reduction_reads_its_rows_once(store, shuffled):
    keys = store.sparkSession.range(40).select("id")
    plan = executed_plan(tw.reduce_object(store.table, [keys])).split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1
    kept = bag(tw.reduce_object(store.table, [keys.where("id % 3 = 0")]))
    assert kept == bag(store.table.where("o_id IS NULL OR (o_id % 3 = 0 AND o_id < 40)"))
    assert bag(tw.reduce_object(store.table, [keys.where("false")])) == bag(store.table.where("o_id IS NULL"))


@pytest.mark.parametrize("most, pieces", [(1 << 20, 1), (200, 8)])
@pytest.mark.parametrize("kind", ["exact", "bloom"])
def test_probes_do_not_move_the_probed_table(store, shuffled, monkeypatch, kind, most, pieces):
    ids = shuffled.range(0, 3000, 150).toDF("id")
    asked = shuffled.range(0, 3000).toDF("id").withColumn("id", F.when(F.col("id") % 500 > 0, F.col("id")))
    built = tw.build_exact_filter(ids) if kind == "exact" else tw.build_bloom_filter(ids, 0.001)
    probe = tw.probe_exact if kind == "exact" else tw.probe_bloom
    monkeypatch.setattr(filter_operators, "BROADCAST_BYTES", most)
    found = probe(asked, "id", built)
    plan = executed_plan(found).split("== Initial Plan ==")[0]
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    assert 1 <= plan.count("BroadcastHashJoin") <= pieces and (most > 200 or plan.count("BroadcastHashJoin") > 1)
    members = {r["id"] for r in ids.collect()} - {0, 500, 1000, 1500, 2000, 2500}
    got = [r["id"] for r in found.collect()]
    assert members <= set(got) and len(got) == len(set(got)) and len(got) <= len(members) + 30
    if kind == "exact":
        assert set(got) == members


def test_a_filter_beyond_the_pieces_is_joined_by_a_shuffle(shuffled, monkeypatch):
    monkeypatch.setattr(filter_operators, "BROADCAST_BYTES", 1)
    found = tw.probe_exact(shuffled.range(1000).toDF("id"), "id", tw.build_exact_filter(shuffled.range(0, 1000, 7)))
    assert "Exchange hashpartitioning" in executed_plan(found) and found.count() == 143


def test_bucketed_properties_join_without_an_exchange(sample_enc, sample_dictionary, shuffled, tmp_path):
    path = str(tmp_path / "bucketed")
    tw.write_properties(sample_enc, path, n_buckets=4)
    store = tw.PropertyStore(shuffled, path)
    assert store.n_buckets == 4 and bag(store.table) == bag(sample_enc)
    encoded = tw.encode_query(named(STAR), sample_dictionary)
    found = tw.bgp(store, encoded)
    assert "Exchange hashpartitioning" not in executed_plan(found)
    assert bag(found) == bag(tw.bgp(sample_enc, encoded))
    # another session learns of the buckets, and of properties that came later
    other = shuffled.newSession()
    other.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    shuffled.sql(f"DROP TABLE {properties._table_name(path)}")
    again = tw.bgp(tw.PropertyStore(other, path), encoded)
    assert "Exchange hashpartitioning" not in executed_plan(again) and bag(again) == bag(found)


def test_properties_with_a_hot_subject_are_not_joined_by_buckets(sample_enc, sample_dictionary, shuffled, tmp_path, monkeypatch):
    path = str(tmp_path / "bucketed")
    tw.write_properties(sample_enc, path, n_buckets=4)
    monkeypatch.setattr(properties, "HOT_ROWS", 1)  # two rows of Bo in paints are hot
    store = tw.PropertyStore(shuffled, path)
    encoded = tw.encode_query(named(STAR), sample_dictionary)
    assert store.hot and encoded[0][1] in store.hot and encoded[1][1] not in store.hot
    found = tw.bgp(store, encoded[:2])
    assert "Exchange hashpartitioning" in executed_plan(found) and bag(found) == bag(tw.bgp(sample_enc, encoded[:2]))
    monkeypatch.setattr(properties, "MAX_LISTED", 0)
    assert tw.PropertyStore(shuffled, path).hot is None


def test_raw_properties_can_be_bucketed_too(sample, spark, tmp_path):
    path = str(tmp_path / "raw")
    for rows in (sample.where(F.col("s") == iri("Bo")), sample):  # the second replaces the first
        tw.write_properties(rows, path, n_buckets=3)
    store = tw.PropertyStore(spark, path, encoded=False)
    assert bag(store.property(iri("paints"))) == bag(sample.where(F.col("p") == iri("paints")))
    assert store.property(iri("unheard")).count() == 0


def test_only_new_reductions_are_computed(sample, spark, tmp_path):
    folder, path = str(tmp_path / "triples"), str(tmp_path / "reductions")
    tw.write_properties(sample, folder)
    store = tw.PropertyStore(spark, folder, encoded=False)
    one, two = named(QUERIES[2]), named(QUERIES[3])
    first = {r["name"]: r["n_rows"] for r in tw.write_workload(store, tw.pattern_table(spark, {"a": one}), path).collect()}
    both = tw.pattern_table(spark, {"a": one, "b": two})
    new = tw.workload_reductions(store, both, tw.read_catalog(spark, path, tw.version_of(store)).select("name"))
    assert not {r["name"] for r in new.collect()} & set(first)
    opened = {f.split("/p=")[1].split("/")[0] for f in new.inputFiles() if "/p=" in f}
    names = {unquote(unquote(f)).removeprefix(R) for f in opened}  # the folder's name is escaped, and its URI again
    assert names == {"paints", "born"}  # what b shares with a is not read
    catalog = {r["name"]: r["n_rows"] for r in tw.write_workload(store, both, path).collect()}
    assert first.items() <= catalog.items() and len(catalog) > len(first)
    assert {r["name"]: r["n_rows"] for r in tw.write_workload(store, both, path).collect()} == catalog


def test_a_known_empty_reduction_ends_the_query(sample, spark, tmp_path):
    folder, path = str(tmp_path / "triples"), str(tmp_path / "reductions")
    tw.write_properties(sample, folder)
    store = tw.PropertyStore(spark, folder, encoded=False)
    patterns = named(QUERIES[6])
    catalog = tw.write_workload(store, tw.pattern_table(spark, {"q": patterns}), path)
    assert [r["n_rows"] for r in catalog.collect()] == [0, 0]
    found = tw.reduced_bgp(store, patterns, ["z", "x"], stored=path)
    assert found.columns == ["z", "x"] and found.count() == 0 and "FileScan" not in executed_plan(found)
    version = tw.version_of(store)
    assert tw.read_stored(spark, path, [r["name"] for r in catalog.collect()], False, version) == {}


@pytest.mark.parametrize("kind", ["exact", "bloom"])
def test_candidates_of_a_workload(sample_enc, sample_dictionary, spark, kind):
    built = tw.build_all_filters(sample_enc, kind, 0.0001)
    asked = [("Di", "?p", "?x"), ("?x", "?q", "Cy"), ("Bo", "?p", "Cy"), ("?x", "teaches", "Cy"), ("?s", "?p", "?o"), ("Bo", "?p", '"1910"'), ("Nobody", "?p", "?x")]
    patterns = tw.encode_patterns(tw.pattern_table(spark, {"q": named(asked)}), sample_dictionary)
    found = {(r["pattern_id"], r["p"]) for r in tw.workload_candidates(built, patterns).collect()}
    ids = {r["term"]: r["id"] for r in sample_dictionary.collect()}
    want = {(0, p) for s, p, _ in SAMPLE if s == "Di"} | {(1, p) for _, p, o in SAMPLE if o == "Cy"}
    want |= {(2, p) for p in ("teaches", "admires")} | {(5, p) for s, p, _ in SAMPLE if s == "Bo"}
    want = {(k, ids[iri(p)]) for k, p in want}
    assert want <= found and (kind == "bloom" or found == want)


def test_lines_that_are_no_statements_are_refused(spark, tmp_path):
    bad = ['<> <p> <o> .', '<s> <> <o> .', '<s> <p> <> .', '<s> <p> "a" "b" .', '<s> <p> "a"b" .', "<s> <p> <o>"]
    good = ['<s> <p> "a \\" b" .', "<s> <p> _:b . # \"c\""]
    (tmp_path / "x.nt").write_text("\n".join(bad + good))
    path = str(tmp_path / "x.nt")
    assert sorted(r["value"] for r in tw.refused_lines(spark, path).collect()) == sorted(bad)
    assert bag(tw.read_ntriples(spark, path)) == [("s", "p", '"a \\" b"'), ("s", "p", "_:b")]
    with pytest.raises(Exception, match="not a statement"):
        tw.read_ntriples(spark, path, mode="fail").collect()


@pytest.mark.parametrize("pieces", [8, 0])
def test_rows_of_an_encoded_query_are_reduced_where_they_are(store, sample, shuffled, monkeypatch, pieces):
    monkeypatch.setattr(filter_operators, "MAX_PIECES", pieces)  # 0: beyond the pieces both are shuffled
    for patterns in (QUERIES[2], [("?x", "owns", "?w"), ("?w", "?p", "?v")]):
        encoded = tw.encode_query(named(patterns), store.dictionary)
        plain = tw.PropertyStore(store.sparkSession, store.path)
        for source in (store, plain):
            keys = tw.shared_keys(source, encoded, constants=True)
            for pattern in encoded:
                reduced = tw.reduce_pattern(source, pattern, encoded, shared=keys)
                plan = reduced._jdf.queryExecution().executedPlan().toString()
                moved = "Exchange hashpartitioning" in plan
                assert moved == (pieces == 0)
                assert bag(reduced) == bag(tw.reduce_pattern(source, pattern, encoded))
        found = tw.decode_bindings(tw.reduced_bgp(plain, encoded), store.dictionary)
        assert bag(found) == bag(tw.bgp(sample, named(patterns)))
