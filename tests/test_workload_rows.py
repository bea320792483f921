"""The rows of a workload's reductions: joined once, with words of few or many nodes, and written small."""

import re

import pytest
from pyspark.sql import functions as F

import tripleweft as tw
from tests.conftest import bag
from tests.test_patterns_and_joins import CONJUNCTIONS, SCHEMA, TRIPLES
from tests.test_reductions_and_filters import executed_plan, hot_triples, skew_session, workload_by_hand  # noqa: F401
from tripleweft.operators import reductions as operators
from tripleweft.session import ADVISED, SHUFFLE_CLEANUP, materialize, write_settings
from tripleweft.sources import reductions as sources

QUERIES = {f"q{i}": patterns for i, patterns in enumerate(CONJUNCTIONS)}


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(TRIPLES, SCHEMA).cache()


@pytest.fixture
def no_broadcasts(spark):
    """Only those that are asked for."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def expected_rows():
    return sorted(((n, *t) for n, ts in workload_by_hand(QUERIES).items() for t in ts), key=repr)


@pytest.fixture
def written(monkeypatch):
    """Plans and sizes of the tables that are written, by name."""
    tables = {}

    def watched(df, name):
        plan = executed_plan(df)
        table = materialize(df, name)
        tables[name] = plan, table.columns, table.count()
        return table

    monkeypatch.setattr(operators, "materialize", watched)
    return tables


@pytest.mark.parametrize("few", [0, 3, 1_000_000])
def test_rows_are_shuffled_once_however_often_they_are_read(spark, raw, monkeypatch, no_broadcasts, written, few):
    monkeypatch.setattr(operators, "FEW_NODES", few)
    found = tw.workload_reductions(raw, tw.pattern_table(spark, QUERIES))
    assert not re.search(r"Exchange hashpartitioning\([^)]*\bkey#", executed_plan(found))
    assert bag(found) == expected_rows()
    assert ("kept-rows" in written) == (few < 1_000_000)
    name = min(workload_by_hand(QUERIES))
    assert bag(found.where(F.col("name") == name)) == [row for row in expected_rows() if row[0] == name]


def test_sets_of_columns_that_are_too_many_to_broadcast(spark, raw, monkeypatch):
    small = operators.is_small
    monkeypatch.setattr(operators, "is_small", lambda df, *most: "reduction" not in df.columns and small(df, *most))
    assert bag(tw.workload_reductions(raw, tw.pattern_table(spark, QUERIES))) == expected_rows()


def test_nodes_that_are_too_large_to_broadcast(spark, raw, monkeypatch):
    small = operators.is_small
    monkeypatch.setattr(operators, "is_small", lambda df, *most: not most and small(df))
    assert bag(tw.workload_reductions(raw, tw.pattern_table(spark, QUERIES))) == expected_rows()


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_encoded_rows(spark, sample, sample_enc, sample_dictionary, monkeypatch, few):
    monkeypatch.setattr(operators, "FEW_NODES", few)
    from tests.test_stored_filters import QUERIES as queries, named

    queries = {f"q{i}": named(q) for i, q in enumerate(queries)}
    plain = tw.workload_reductions(sample, tw.pattern_table(spark, queries))
    encoded = {name: tw.encode_query(q, sample_dictionary) for name, q in queries.items()}
    found = tw.workload_reductions(sample_enc, tw.pattern_table(spark, encoded))
    sizes = [bag(f.groupBy("name").agg(F.count(F.lit(1))).select("count(1)")) for f in (plain, found)]
    assert sizes[0] == sizes[1] and found.columns == ["name", *sample_enc.columns]


def test_only_rows_that_survive_are_written_without_their_property(spark, monkeypatch, written):
    monkeypatch.setattr(operators, "FEW_NODES", 0)
    rows = [(f"x{i}", "a", f"y{i}") for i in range(50)] + [(f"z{i}", "b", "w") for i in range(50)] + [("x1", "b", "w"), ("x1", "c", "x2")]
    triples = spark.createDataFrame(rows, "s STRING, p STRING, o STRING")
    patterns = [("?x", "a", "?y"), ("?x", "b", "?z")]
    found = tw.workload_reductions(triples, tw.pattern_table(spark, {"q": patterns}))
    _, columns, n = written["kept-rows"]
    assert n == 2 and "p" not in columns and "key" not in columns
    assert [row[1:] for row in bag(found)] == [("x1", "a", "y1"), ("x1", "b", "w")]


def test_a_null_subject_is_no_literal(spark):
    rows = [("x", "a", "y"), (None, "a", "y"), ("x", "b", '"1"'), ("z", "b", "y")]
    triples = spark.createDataFrame(rows, "s STRING, p STRING, o STRING")
    patterns = [("?x", "a", "?y"), ("?x", "b", "?y")]
    found = tw.workload_reductions(triples, tw.pattern_table(spark, {"q": patterns}))
    assert [row[1:] for row in bag(found.where(F.startswith("name", F.lit("a_TRPS"))))] == [("x", "a", "y")]
    assert [row[1:] for row in bag(found.where(F.startswith("name", F.lit("b_TRPO"))))] == [("x", "b", '"1"'), ("z", "b", "y")]


def test_hot_subject_is_split_when_rows_are_kept(skew_session, monkeypatch, written):  # noqa: F811
    monkeypatch.setattr(operators, "FEW_NODES", 0)
    triples = hot_triples(skew_session)
    patterns = tw.pattern_table(skew_session, {"q": [("?x", "0", "?y"), ("?x", "1", "?z")]})
    assert tw.workload_reductions(triples, patterns).where(F.startswith("name", F.lit("0_"))).count() == 200000
    assert "skew=true" in written["kept-rows"][0]


def shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_writes_leave_no_shuffle_files(spark, raw, tmp_path):
    before = shuffle_files(spark)
    materialize(raw.groupBy("s").count(), "counted")
    tw.write_properties(raw, str(tmp_path / "store"))
    assert shuffle_files(spark) <= before


def test_settings_of_a_write_are_put_back(spark):
    before = spark.conf.get(ADVISED)
    try:
        spark.conf.set(ADVISED, "8MB")
        with pytest.raises(KeyError), write_settings(spark, sources.SORT_SHARE):
            assert spark.conf.get(ADVISED) == str(2 << 20) and spark.conf.get(SHUFFLE_CLEANUP) == "true"
            raise KeyError
        assert spark.conf.get(ADVISED) == "8MB" and spark.conf.get(SHUFFLE_CLEANUP) == "false"
    finally:
        spark.conf.set(ADVISED, before)
