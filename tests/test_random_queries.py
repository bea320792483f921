"""Random queries and a random workload against the brute-force matcher."""

import random

import tripleweft as tw
from tests.conftest import bag
from tests.test_patterns_and_joins import SCHEMA, TRIPLES, decoded, rows_by_hand
from tests.test_reductions_and_filters import workload_by_hand


def random_queries(seed: int, n: int) -> dict[str, list[tuple]]:
    rng = random.Random(seed)

    def term(position: str) -> str:
        if rng.random() < 0.65:
            return rng.choice(["?x", "?y", "?z", "?w"])
        return rng.choice(["a", "b", "c"] + (['"x"', '"10"'] if position == "o" else []))

    return {
        f"q{i}": [tuple(map(term, "spo")) for _ in range(rng.choice([1, 2, 2, 3, 3]))]
        for i in range(n)
    }


def test_random_queries(spark):
    raw = spark.createDataFrame(TRIPLES, SCHEMA).cache()
    dictionary = tw.build_dictionary(raw).cache()
    enc = tw.encode_triples(raw, dictionary).cache()
    terms = {row["id"]: row["term"] for row in dictionary.collect()}
    queries = random_queries(11, 14)
    for patterns in queries.values():
        names = list(dict.fromkeys(t[1:] for q in patterns for t in q if t.startswith("?")))
        expected = rows_by_hand(patterns, names)
        encoded = tw.encode_query(patterns, dictionary)
        for solve in (tw.bgp, tw.reduced_bgp):
            found = solve(raw, patterns, allow_product=True)
            found_enc = solve(enc, encoded, allow_product=True)
            if names:
                assert bag(found) == expected, patterns
                assert decoded(found_enc, terms) == expected, patterns
            else:
                assert found.count() == found_enc.count() == len(expected), patterns
    reductions = tw.workload_reductions(raw, tw.pattern_table(spark, queries))
    by_hand = workload_by_hand(queries)
    assert bag(reductions) == sorted(
        ((name, *t) for name, rows in by_hand.items() for t in rows), key=repr)
