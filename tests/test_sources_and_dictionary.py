"""Text formats, property tables, dictionary building and encoding."""

import json
import re

import pytest
from pyspark.sql import functions as F

import tripleweft as tw
from tests.conftest import R, SAMPLE, bag, iri, sample_lines
from tripleweft.functions.terms import as_id
from tripleweft.session import materialize, scratch_dir


def test_ntriples_space_and_tab(spark, tmp_path, sample):
    expected = sorted((tuple(map(iri, triple)) for triple in SAMPLE), key=repr)
    assert bag(sample) == expected
    (tmp_path / "tab.nt").write_text("\n".join(sample_lines("\t")))
    assert bag(tw.read_ntriples(spark, str(tmp_path / "tab.nt"), "tab")) == expected


def test_ntriples_odd_lines(spark, tmp_path):
    lines = [
        "# a comment .",
        "",
        "   ",
        "<a> <b> <c> .",
        "<a> <b> <c>.",
        "  <a>  <b>  \"two  spaces . and a dot.\"@en-GB  .  ",
        '<a> <b> "1"^^<http://www.w3.org/2001/XMLSchema#integer> .',
        "_:b0 <b> _:b1 .",
        "<a> <b> .",
        "no end <b> <c>",
        "broken",
        ".",
        '<a> <b> "quoted \\" and \\\\ back" .',
        "<a> <b> \"" + "long " * 20000 + "\" .",
    ]
    (tmp_path / "odd.nt").write_text("\n".join(lines) + "\n")
    assert bag(tw.read_ntriples(spark, str(tmp_path / "odd.nt"))) == sorted([
        ("a", "b", "c"), ("a", "b", "c"),
        ("a", "b", '"two  spaces . and a dot."@en-GB'),
        ("a", "b", '"1"^^<http://www.w3.org/2001/XMLSchema#integer>'),
        ("_:b0", "b", "_:b1"),
        ("a", "b", '"quoted \\" and \\\\ back"'),
        ("a", "b", '"' + "long " * 20000 + '"'),
    ], key=repr)


def test_blank_nodes_join_as_objects(spark):
    triples = spark.createDataFrame(
        [("a", "p", "_:b0"), ("_:b0", "q", '"v"')], "s STRING, p STRING, o STRING")
    dictionary = tw.build_dictionary(triples)
    enc = tw.encode_triples(triples, dictionary)
    patterns = tw.encode_query([("?x", "p", "?y"), ("?y", "q", "?z")], dictionary)
    assert bag(tw.decode_bindings(tw.bgp(enc, patterns), dictionary)) == [("a", "_:b0", '"v"')]


def test_encoded_text_round_trip(spark, sample_enc, tmp_path):
    tw.write_encoded(sample_enc, str(tmp_path / "enc"))
    assert bag(tw.read_encoded(spark, str(tmp_path / "enc"))) == bag(sample_enc)
    (tmp_path / "bad.txt").write_text('1 2 "a b"\nx 2 3\n1 2\n\n4 5 6\n')
    assert bag(tw.read_encoded(spark, str(tmp_path / "bad.txt"))) == [
        (1, 2, '"a b"', None), (4, 5, "6", 6)]


def test_property_store(spark, tmp_path, sample, sample_enc):
    raw_path, enc_path = str(tmp_path / "raw"), str(tmp_path / "enc")
    tw.write_properties(sample, raw_path)
    tw.write_properties(sample_enc, enc_path)
    assert bag(tw.scan_properties(spark, raw_path, encoded=False)) == bag(sample)
    assert bag(tw.scan_properties(spark, enc_path)) == bag(sample_enc)
    works = tw.scan_properties(spark, raw_path, [iri("paints"), iri("unheard")], encoded=False)
    assert bag(works) == bag(sample.where(F.col("p") == iri("paints")))
    store = tw.PropertyStore(spark, raw_path, encoded=False)
    patterns = [(iri("Bo"), "?p", "?o"), (iri("Bo"), iri("admires"), "?o")]
    assert bag(tw.reduced_bgp(store, patterns)) == bag(tw.bgp(sample, patterns))
    none = [("?x", iri("unheard"), "?y")]
    assert tw.bgp(store, none).isEmpty() and tw.reduced_bgp(store, none).isEmpty()


def test_property_names_that_need_escaping(spark, tmp_path):
    names = ["http://x.org/a?b=c&d#e", "50%", "a*b", "[q]", "{r}", "007", "2020-01-01", "é^|~"]
    triples = spark.createDataFrame([("s", n, '"o"') for n in names], "s STRING, p STRING, o STRING")
    tw.write_properties(triples, str(tmp_path / "odd"))
    for name in names:
        found = tw.scan_properties(spark, str(tmp_path / "odd"), [name], encoded=False)
        assert bag(found) == [("s", name, '"o"')]
        assert len(found.inputFiles()) == 1
    assert bag(tw.scan_properties(spark, str(tmp_path / "odd"), encoded=False)) == bag(triples)


def test_property_scan_reads_one_directory_and_its_size(spark, tmp_path, sample_enc):
    path = str(tmp_path / "enc")
    tw.write_properties(sample_enc, path)
    p = sample_enc.first()["p"]
    one = tw.scan_properties(spark, path, [p])
    assert all(f"/p={p}/" in name for name in one.inputFiles())

    def size(df):
        return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()

    assert size(one) < size(tw.scan_properties(spark, path).where(F.col("p") == p))


def test_dictionary_export(spark, tmp_path):
    dictionary = spark.createDataFrame([(1, 'a "quoted" term'), (2, "b")], "id BIGINT, term STRING")
    tw.export_dictionary(dictionary, str(tmp_path / "tsv"))
    lines = sorted(row[0] for row in spark.read.text(str(tmp_path / "tsv")).collect())
    assert lines == ['1\ta "quoted" term', "2\tb"]


def test_encode_then_decode(sample, sample_enc, sample_dictionary):
    assert bag(tw.decode_bindings(sample_enc.drop("o_id"), sample_dictionary)) == bag(sample)
    assert sample_enc.where("o_id IS NOT NULL").count() == 18


def test_dictionary_over_many_partitions(spark):
    terms = spark.range(20000).select(
        F.concat(F.lit("t"), F.col("id")).alias("s"), F.lit("p").alias("p"), F.lit('"l"').alias("o"))
    rows = sorted(bag(tw.build_dictionary(terms).select("id", "term")))
    assert [r[0] for r in rows] == list(range(1, 20002))
    assert [r[1] for r in rows] == sorted(r[1] for r in rows)


def test_extending_twice_keeps_ids(spark, sample):
    first = materialize(tw.build_dictionary(sample.where(F.col("p") == iri("paints"))), "d")
    second = materialize(tw.extend_dictionary(first, sample), "d")
    third = tw.extend_dictionary(second, sample)
    assert set(bag(first)) <= set(bag(second)) and bag(third) == bag(second)
    assert sorted(row["id"] for row in second.collect()) == list(range(1, 18))


def test_encode_patterns(spark, sample_dictionary):
    ids = {row["term"]: str(row["id"]) for row in sample_dictionary.collect()}
    table = tw.pattern_table(spark, {
        "q": [("?s", iri("paints"), "?o"), (iri("Bo"), "?p", '"1910"'), ("?s", iri("none"), "?o")]})
    rows = {(r["query_id"], r["pattern_id"]): (r["s"], r["p"], r["o"], r["matched"])
            for r in tw.encode_patterns(table, sample_dictionary).collect()}
    assert rows == {
        ("q", 0): ("?s", ids[iri("paints")], "?o", True),
        ("q", 1): (ids[iri("Bo")], "?p", '"1910"', True),
        ("q", 2): ("?s", iri("none"), "?o", False),
    }


def test_curies_from_a_prefix_file(spark, tmp_path):
    (tmp_path / "prefixes.json").write_text(
        json.dumps({"@context": {"mus": R, "ex": "http://ex.org/"}}, indent=2))
    prefixes = tw.read_prefixes(spark, str(tmp_path / "prefixes.json"))
    values = ["mus:Ada", "ex:a:b", "zzz:x", "plain", '"mus:Ada"', "http://ex.org/a", "?x"]
    df = spark.createDataFrame([(v, v) for v in values], "given STRING, v STRING")
    found = {r["given"]: r["v"] for r in tw.expand_curies(df, "v", prefixes).collect()}
    assert found == {**{v: v for v in values}, "mus:Ada": R + "Ada", "ex:a:b": "http://ex.org/a:b"}


def test_scratch_folder_comes_from_the_session(spark):
    assert scratch_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    files = materialize(spark.range(3), "t").inputFiles()
    assert all(spark.conf.get("spark.checkpoint.dir") in name for name in files)


@pytest.mark.parametrize("n", [None, 5])
@pytest.mark.parametrize("col", ["s", "o"])
def test_partition_by_keeps_rows(sample, col, n):
    assert bag(tw.partition_by(sample, col, n)) == bag(sample)


def test_ntriples_mixed_blanks_and_comments(spark, tmp_path):
    lines = [
        '<a> <p>\t"x y" .', "<a>\t<p>\t<b>\t.", "<a><p><b>.", '<a> <p> <b> . # note "x" .', '<a><p>"v"@en.#x',
        '<a> <p> "say "hi" there" .', "<a> <p> _:b1.", "<a> <p> .", "broken", "# comment", "\t",
    ]
    (tmp_path / "mixed.nt").write_text("\n".join(lines) + "\n")
    path = str(tmp_path / "mixed.nt")
    assert bag(tw.read_ntriples(spark, path)) == sorted([
        ("a", "p", '"x y"'), ("a", "p", "b"), ("a", "p", "b"), ("a", "p", "b"), ("a", "p", '"v"@en'), ("a", "p", "_:b1"),
    ], key=repr)
    refused = sorted(r["value"] for r in tw.refused_lines(spark, path).collect())
    assert refused == ['<a> <p> "say "hi" there" .', "<a> <p> .", "broken"]
    with pytest.raises(Exception, match="not a statement"):
        tw.read_ntriples(spark, path, mode="fail").collect()


def test_encoding_with_an_old_dictionary(spark):
    triples = spark.createDataFrame(
        [("a", "p", "b"), ("new", "p", '"v"'), ("a", "newp", "b"), ("a", "p", "newo")], "s STRING, p STRING, o STRING")
    dictionary = tw.build_dictionary(triples.where("s = 'a' AND p = 'p' AND o = 'b'"))
    with pytest.raises(Exception, match="not in the dictionary: new"):
        tw.encode_triples(triples, dictionary).collect()
    assert [r["o"] for r in tw.encode_triples(triples, dictionary, unknown="drop").orderBy("o").collect()] == ["2", "newo"]


def test_half_written_slot_of_another_workload(spark, tmp_path):
    schema = "name STRING, s STRING, p STRING, o STRING"
    path = str(tmp_path / "reductions")
    tw.write_reductions(spark.createDataFrame([("whole", "a", "p", "b"), ("half", "a", "p", "b")], schema), path)
    catalog = spark.read.parquet(f"{path}/catalog").where("name <> 'half'")
    rows = [tuple(r) for r in catalog.collect()]
    spark.createDataFrame(rows, catalog.schema).write.mode("overwrite").parquet(f"{path}/catalog")  # as if that run had died
    tw.write_reductions(spark.createDataFrame([("other", "c", "q", "d")], schema), path)
    assert {r["name"] for r in tw.read_catalog(spark, path).collect()} == {"whole", "other"}


def test_only_digits_are_cast_to_ids(spark):
    texts = ['"F"', "12", "x12", " 12", "9" * 30, None]
    df = spark.createDataFrame([(text, 7) for text in texts], "t STRING, n INT")
    assert [row[0] for row in df.select(as_id(df, "t")).collect()] == [None, 12, None, None, None, None]
    assert {row[0] for row in df.select(as_id(df, "n")).collect()} == {7}


def test_variables_of_few_terms_are_decoded_by_broadcasts(spark, monkeypatch):
    dictionary = spark.range(1, 401).select("id", F.concat(F.lit("t"), "id").alias("term"))
    bindings = spark.range(1, 391).select(
        F.col("id").alias("a"), F.when(F.col("id") % 3 == 0, F.lit('"x"')).otherwise(F.lit("1")).alias("b"))
    monkeypatch.setattr("tripleweft.operators.dictionary.BROADCAST_ROWS", 20)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        decoded = tw.decode_bindings(bindings, dictionary)
        plan = decoded._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") == 1 and plan.count("SortMergeJoin") == 1
        assert bag(decoded) == bag(spark.createDataFrame(
            [(f"t{i}", '"x"' if i % 3 == 0 else "t1") for i in range(1, 391)], "a STRING, b STRING"))
    finally:
        spark.conf.set(key, before)


def test_subjects_are_encoded_first_and_id_texts_are_not_shuffled(spark, tmp_path, sample, sample_enc, monkeypatch):
    encoded = tw.encode_triples(sample, tw.build_dictionary(sample))
    plan = encoded._jdf.queryExecution().optimizedPlan().toString()
    assert re.findall(r"Join LeftOuter, \(([so])#", plan) == ["s", "o", "s"]  # literals, resources
    odd = spark.createDataFrame([(1, 2, "007", 7), (1, 2, "7", 7), (1, 2, '"x"', None), (1, 2, None, None)], sample_enc.schema)
    rows = sample_enc.select("s", "p", "o", "o_id").unionByName(odd)
    for n_buckets in (None, 2):
        dealt = []
        kept = type(rows).hint
        monkeypatch.setattr(type(rows), "hint", lambda df, *how: dealt.append(df) or kept(df, *how))
        path = str(tmp_path / f"store-{n_buckets}")
        tw.write_properties(rows, path, n_buckets)
        monkeypatch.undo()
        assert bag(tw.scan_properties(spark, path)) == bag(rows)
        assert dealt[0].where("o = CAST(o_id AS STRING)").count() == 0 and dealt[0].count() == rows.count()


def test_decoding_moves_an_id_once_and_passes_other_values_through(spark, monkeypatch):
    dictionary = spark.range(1, 401).select("id", F.concat(F.lit("t"), "id").alias("term"))
    rows = [(1, "007"), (2, "7"), (-3, '"x"'), (900, "900"), (None, None), (5, "0900"), (6, "-4"), (2, "t")]
    bindings = spark.createDataFrame(rows, "a BIGINT, b STRING")
    monkeypatch.setattr("tripleweft.operators.dictionary.BROADCAST_ROWS", 0)
    decoded = tw.decode_bindings(bindings, dictionary)
    assert bag(decoded) == bag(spark.createDataFrame(
        [("t1", "t7"), ("t2", "t7"), ("-3", '"x"'), ("900", "900"), (None, None), ("t5", "0900"), ("t6", "-4"), ("t2", "t")],
        "a STRING, b STRING"))
    plan = decoded._jdf.queryExecution().optimizedPlan()
    join = plan.children().head()  # below the last projection
    assert "Join LeftOuter" in join.toString().splitlines()[0]
    assert join.children().head().output().size() == 3  # the id, a value that is none, the other variable
