"""The divergence audit against its SQL, on given and on untidy tables."""

import random

import duckdb
import numpy as np
import pytest

from tests.conftest import SF_DIR
from tripleweft.llm import divergence

COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def untidy_rows():
    draw = random.Random(4)
    words = [f"{a}{b}" for a in ("Az", "é", "日本", "x", "ß", "İ") for b in ("", "q", "zz", "É", "M")]
    rows = []
    for k in range(400):
        text = " ".join(draw.choice(words[: 5 + k % 25]) for _ in range(draw.randrange(60)))
        rows.append((k % 350, text, draw.choice(["en", "de", "fr", None, ""]), draw.choice(["a", "b", "ä", "z", None, ""])))
    rows += [rows[0]] * 3
    rows += [(1, None, "en", "only null"), (2, "", "en", "only empty"), (3, "12 34 _-_", "en", "no letters"), (None, "Az Az q1w", "en", "a")]
    rows += [(4, "rare words here", "pt", "a"), (5, "others there", "pt", "b"), (6, "alone", "nl", "a"), (7, "x " * 30000, "en", "a")]
    return rows


def same_as_sql(report, con):
    got = sorted(map(tuple, report.select(*COLUMNS).collect()))
    assert got == sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({divergence.SQL})").fetchall())
    return got


@pytest.mark.parametrize("sizes", [{}, {"BLOCK_ENTRIES": 16, "TILE": 2, "STEP_TERMS": 3}])
def test_untidy_table(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(divergence, name, value)
    docs = spark.createDataFrame(untidy_rows(), "doc_id bigint, text string, lang string, source string").repartition(6)
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    got = same_as_sql(divergence.divergence_report(docs.selectExpr("*", "1 AS n", "'x' AS term", "2 AS total")), con)
    assert ("pt", "a", "pair", "b", 0, 1) in got and ("nl", "a") not in {r[:2] for r in got}
    assert divergence.divergence_report(docs.where("false")).count() == 0


def test_given_table(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{SF_DIR}/documents.parquet'")
    same_as_sql(divergence.divergence_report(spark.read.parquet(f"{SF_DIR}/documents.parquet")), con)


def test_shares_of_large_counts_are_exact():
    n = np.array([0, 1, 10**12, 4 * 10**15 - 1], np.int64)
    total, n_terms = 4 * 10**15, 12345
    assert shares_of(n, total, n_terms) == [1 + 10**9 * (int(x) + 1) // (total + n_terms) for x in n]


def shares_of(n, total, n_terms):
    return divergence.shares(n, total, n_terms).tolist()


def test_products_equal_sums_over_terms():
    draw = np.random.default_rng(3)
    counts = draw.geometric(0.2, (700, 5)) * (draw.random((700, 5)) < 0.5)
    totals = counts.sum(axis=0)
    p = np.stack([divergence.shares(counts[:, g], int(totals[g]), 900) for g in range(5)])
    want = [[int(((p[g] - p[h]) ** 2 // p[h]).sum()) for h in (1, 2, 4)] for g in (0, 2, 3)]
    got = divergence.joint_prices(counts, np.array([0, 2, 3]), np.array([1, 2, 4]), totals, 900)
    assert got.tolist() == want
