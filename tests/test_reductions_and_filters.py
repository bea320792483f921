"""Reductions never change answers, filters never miss, hot keys are split."""

import random

import pytest
from pyspark.sql import functions as F

import tripleweft as tw
from tests.conftest import bag
from tests.test_patterns_and_joins import CONJUNCTIONS, TRIPLES, SCHEMA
from tripleweft.functions.bits import bloom_shape
from tripleweft.operators.reductions import OWN, shared_keys


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(TRIPLES, SCHEMA).cache()


def reduce_by_hand(p, col, partners, triples=TRIPLES):
    """Rows of property p whose column is a node of all partner columns."""
    def nodes(q, c):
        rows = [t for t in triples if q in ("ANY", t[1])]
        return {t[0] if c == "s" else t[2] for t in rows if c == "s" or not t[2].startswith('"')}

    i = 0 if col == "s" else 2
    return [t for t in triples if t[1] == p and (
        t[i].startswith('"') or all(t[i] in nodes(*q) for q in partners))]


def workload_by_hand(queries):
    """Names and rows of all distinct reductions, from the definition."""
    properties = sorted({t[1] for t in TRIPLES})
    found = {}
    for patterns in queries.values():
        for own in patterns:
            for p in properties if own[1].startswith("?") else [own[1]]:
                for col, var in (("s", own[0]), ("o", own[2])):
                    if not var.startswith("?"):
                        continue
                    partners = set()
                    for other in patterns:
                        if var in (other[0], other[2]):
                            q = "ANY" if other[1].startswith("?") else other[1]
                            partners.add((p if other == own else q, "s" if other[0] == var else "o"))
                    partners -= {(p, col)}
                    if partners:
                        tags = sorted(f"{q}_TRP{c.upper()}" for q, c in partners)
                        name = "_JOIN_".join([f"{p}_TRP{col.upper()}", *tags])
                        found[name] = reduce_by_hand(p, col, partners)
    return found


def test_workload_reductions_by_hand(spark, raw):
    queries = {f"q{i}": patterns for i, patterns in enumerate(CONJUNCTIONS)}
    expected = workload_by_hand(queries)
    rows = bag(tw.workload_reductions(raw, tw.pattern_table(spark, queries)))
    assert rows == sorted(((n, *t) for n, ts in expected.items() for t in ts), key=repr)


@pytest.mark.parametrize("max_words", [0, 16])
def test_reductions_over_more_columns_than_a_word_has_bits(spark, monkeypatch, max_words):
    """The columns of a node as bits of several words, or as lists, without lists over the triples."""
    monkeypatch.setattr("tripleweft.operators.reductions.MAX_WORDS", max_words)
    n = 70
    rows = [(f"n{(i * k) % 9}", f"p{i}", f"n{(i + k) % 9}") for i in range(n) for k in range(4)]
    queries = {f"q{i}": [("?x", f"p{i}", "?y"), ("?y", f"p{(i + 1) % n}", "?z")] for i in range(n)}
    found = tw.workload_reductions(spark.createDataFrame(rows, "s STRING, p STRING, o STRING"), tw.pattern_table(spark, queries))
    assert ("ObjectHashAggregate" in executed_plan(found)) == (max_words == 0)
    expected = []
    for i in range(n):
        first, second = f"p{i}", f"p{(i + 1) % n}"
        subjects, objects = {s for s, p, _ in rows if p == second}, {o for _, p, o in rows if p == first}
        expected += [(f"{first}_TRPO_JOIN_{second}_TRPS", *row) for row in rows if row[1] == first and row[2] in subjects]
        expected += [(f"{second}_TRPS_JOIN_{first}_TRPO", *row) for row in rows if row[1] == second and row[0] in objects]
    assert bag(found) == sorted(expected, key=repr)


def test_stored_reductions(spark, raw, tmp_path):
    path = str(tmp_path / "reductions")
    queries = {f"q{i}": patterns for i, patterns in enumerate(CONJUNCTIONS)}
    expected = {n: ts for n, ts in workload_by_hand(queries).items() if ts}
    reductions = tw.workload_reductions(raw, tw.pattern_table(spark, queries))
    some = sorted(expected)[: len(expected) // 2]
    first = tw.write_reductions(reductions.where(F.col("name").isin(some)), path)
    assert bag(first) == [(n, len(expected[n])) for n in some]
    for _ in range(2):  # the second time there is nothing new
        catalog = tw.write_reductions(reductions, path)
        assert bag(catalog) == sorted(((n, len(ts)) for n, ts in expected.items()), key=repr)
    for name in some[:3] + sorted(expected)[-3:]:
        rows = tw.read_reduction(spark, path, name, encoded=False)
        assert bag(rows) == sorted(expected[name], key=repr)
    for patterns in CONJUNCTIONS:
        assert bag(tw.reduced_bgp(raw, patterns, stored=path)) == bag(tw.bgp(raw, patterns))


def test_the_smaller_stored_reduction_is_read(spark, raw, tmp_path):
    path, patterns = str(tmp_path / "reductions"), [("?x", "b", "?y"), ("?y", "c", "?x")]
    names = tw.reduction_names(patterns[0], patterns)
    tw.write_reductions(tw.workload_reductions(raw, tw.pattern_table(spark, {"q": patterns})), path)
    sizes = {r["name"]: r["n_rows"] for r in tw.read_catalog(spark, path).collect()}
    known = tw.read_stored(spark, path, names.values(), encoded=False)
    assert list(known) == sorted(known, key=lambda n: (sizes[n], n)) and len(known) == 2
    assert tw.reduce_pattern(raw, patterns[0], patterns, known).count() == min(sizes[n] for n in known)
    assert bag(tw.reduced_bgp(raw, patterns, stored=path)) == bag(tw.bgp(raw, patterns))


def test_constants_shrink_the_key_sets(raw):
    patterns = [("?x", "b", "?y"), ("?x", "a", '"x"')]
    held = {t[0] for t in TRIPLES if t[1:] == ("a", '"x"')} & {t[0] for t in TRIPLES if t[1] == "b"}
    keys = shared_keys(raw, patterns, constants=True)["?x"]
    assert {r["key"] for r in keys.collect()} == held
    assert {r["key"] for r in shared_keys(raw, patterns)["?x"].collect()} > held


def test_rows_written_without_a_record_are_replaced(spark, raw, tmp_path):
    """As after a run that died between data and catalog."""
    path = str(tmp_path / "reductions")
    reductions = raw.select(F.lit("b_TRPS_JOIN_c_TRPS").alias("name"), "s", "p", "o")
    tw.write_reductions(reductions, path)
    spark.createDataFrame([], "name STRING, n_rows BIGINT").write.mode("overwrite").parquet(
        path + "/catalog")
    assert bag(tw.write_reductions(reductions, path)) == [("b_TRPS_JOIN_c_TRPS", len(TRIPLES))]


def test_partners_of_a_pattern():
    knows, unbound = ("?x", "knows", "?y"), ("?y", "?p", "?z")
    assert tw.find_partners(knows, [knows, unbound, ("?w", "?q", "?x")]) == {
        "s": [("ANY", "o")], "o": [("ANY", "s")]}
    assert tw.find_partners(("?x", "?p", "?x"), []) == {"o": [(OWN, "s")]}
    assert tw.find_partners(knows, [knows]) == {}


def test_exact_filter_over_wide_ids(spark):
    rng = random.Random(5)
    ids = [rng.randrange(1, 1 << 40) for _ in range(2000)] + list(range(1, 200))
    members = spark.createDataFrame([(i,) for i in ids] + [(None,)], "id BIGINT")
    built = tw.build_exact_filter(members)
    probes = spark.createDataFrame([(i + d,) for i in ids for d in (-1, 0, 1)] + [(None,)], "x BIGINT")
    found = [row[0] for row in tw.probe_exact(probes, "x", built).collect()]
    assert sorted(found) == sorted(i + d for i in ids for d in (-1, 0, 1) if i + d in set(ids))
    united = tw.union_filters(built, tw.build_exact_filter(spark.range(5000, 5100)))
    both = tw.build_exact_filter(members.unionByName(spark.range(5000, 5100)))
    assert bag(united) == bag(both)


@pytest.mark.parametrize("fpp", [0.1, 0.01, 0.001])
def test_bloom_filter_rate(spark, fpp):
    members = spark.range(0, 40000, 2)
    built = tw.build_bloom_filter(members, fpp)
    assert tw.probe_bloom(members, "id", built).count() == 20000
    wrong = tw.probe_bloom(spark.range(100001, 500001), "id", built).count()
    assert wrong <= 400000 * fpp * 1.1
    bits, _ = bloom_shape(fpp)
    assert built.count() * 64 <= 20000 * bits * 1.5


def test_bloom_filters_of_one_size_unite(spark):
    a = tw.build_bloom_filter(spark.range(0, 1000), 0.01, n_buckets=400)
    b = tw.build_bloom_filter(spark.range(1000, 2000), 0.01, n_buckets=400)
    both = tw.build_bloom_filter(spark.range(0, 2000), 0.01, n_buckets=400)
    assert bag(tw.union_filters(a, b)) == bag(both)
    other = tw.build_bloom_filter(spark.range(0, 1000), 0.01, n_buckets=100)
    with pytest.raises(Exception, match="mixes different values"):
        tw.probe_bloom(spark.range(10), "id", tw.union_filters(a, other)).count()
    with pytest.raises(ValueError):
        tw.union_filters(a, tw.build_exact_filter(spark.range(10)))


@pytest.mark.parametrize("kind", ["exact", "bloom"])
def test_candidates_hold_all_verified_properties(spark, sample_enc, sample_dictionary, kind):
    filters = tw.build_all_filters(sample_enc, kind, 0.01).cache()
    rows = sample_enc.collect()
    ids = [row["id"] for row in sample_dictionary.collect()] + [999]
    for s in random.Random(1).sample(ids, 6) + [999]:
        for o in random.Random(2).sample(ids, 4) + [None, '"1910"']:
            candidates = tw.candidate_properties(filters, s, o)
            held = {r["p"] for r in rows if r["s"] == s}
            if isinstance(o, int):
                held &= {r["p"] for r in rows if r["o_id"] == o}
            found = {row["p"] for row in candidates.collect()}
            assert found == held if kind == "exact" else found >= held
            real = {r["p"] for r in rows if r["s"] == s and (
                o is None or (r["o_id"] == o if isinstance(o, int) else r["o"] == o))}
            assert {r["p"] for r in tw.verify_properties(sample_enc, candidates, s, o).collect()} == real


def test_workload_report(sample):
    from tests.test_sample import QUERIES

    report = tw.workload_report(sample, {name: q[0] for name, q in QUERIES.items()})
    rows = {r["query_id"]: tuple(r)[1:] for r in report.collect()}
    # results, original rows, reduced rows, most patterns on a variable, patterns
    assert rows["two"] == (2, 4 + 5, 2 + 2, 2, 2)
    assert rows["star"][:2] == (2, 3 + 5 + 3 + 4) and rows["star"][3:] == (4, 4)
    # born's literals pass
    assert rows["unbound"] == (2, (3 + 3 + 4 + 5) + 5, (3 + 1 + 4 + 5) + 5, 2, 2)
    assert rows["loop"][:2] == (1, 4) and rows["any"][:2] == (1, 24)
    assert all(reduced <= original for _, original, reduced, _, _ in rows.values())


# ---------------------------------------------------------------- hot keys


@pytest.fixture
def skew_session(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def executed_plan(df) -> str:
    plan = df._jdf.queryExecution().executedPlan()
    plan.execute().count()
    return plan.toString().split("Initial Plan")[0]


def hot_triples(spark, n=600000):
    """A third of all rows share one subject and one object."""
    node = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 50000)
    return spark.range(n).select(
        node.alias("s"), (F.col("id") % 3).alias("p"),
        F.xxhash64("id").cast("string").alias("o"), node.alias("o_id"))


def test_hot_subject_is_split_in_reductions(skew_session):
    triples = hot_triples(skew_session)
    keys = skew_session.range(0, 40000)
    df = tw.reduce_subject(triples, [keys])
    assert "skew=true" in executed_plan(df)
    assert df.count() == triples.where("s < 40000").count()


def test_hot_subject_is_split_in_star_joins(skew_session):
    triples = hot_triples(skew_session)
    once = skew_session.range(0, 50000)
    star = tw.join_bindings(
        tw.join_bindings(triples.select(F.col("s").alias("x"), "o"),
                         once.select(F.col("id").alias("x"), F.col("id").alias("y"))),
        once.select(F.col("id").alias("x"), F.col("id").alias("z")))
    assert executed_plan(star).count("skew=true") == 2
    assert star.count() == triples.count()


def test_hot_object_is_split_when_probing_and_decoding(skew_session, monkeypatch):
    monkeypatch.setattr("tripleweft.operators.filters.MAX_PIECES", 0)  # the filter is not broadcast
    triples = hot_triples(skew_session)
    built = tw.build_exact_filter(skew_session.range(0, 40000))
    assert "skew=true" in executed_plan(tw.probe_exact(triples, "o_id", built))
    dictionary = skew_session.range(0, 50000).select("id", F.col("id").cast("string").alias("term"))
    decoded = tw.decode_bindings(triples.select("o_id", "o"), dictionary, ["o_id"])
    assert "skew=true" in executed_plan(decoded)


def test_hot_property_is_written_by_many_tasks(skew_session, tmp_path):
    triples = hot_triples(skew_session).withColumn("p", F.lit(1).cast("bigint"))
    tw.write_properties(triples, str(tmp_path / "hot"))
    stored = tw.scan_properties(skew_session, str(tmp_path / "hot"))
    assert len(stored.inputFiles()) > 5 and stored.count() == triples.count()
