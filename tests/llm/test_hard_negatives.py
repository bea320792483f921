"""Hard negatives against their SQL and against plain scores."""

import duckdb
import numpy as np
import pytest

from tripleweft.llm import hard_negatives as hn

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def plain(rows):
    """The same by sorting all scores of every anchor; whole numbers of any size."""
    seen = {}
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        own = (label, [float(x) for x in vector])
        seen[vec_id] = min(seen.get(vec_id, own), own)
    table = {k: ((label + 1) % 10 if k % 7 == 0 else label, [int(np.floor(256 * x)) for x in v]) for k, (label, v) in seen.items()}
    out = []
    for anchor, (label, a) in table.items():
        if anchor % 100:
            continue
        scores = sorted((-sum(x * y for x, y in zip(a, b)), k, own == label) for k, (own, b) in table.items() if k != anchor)
        for p, positive, _ in [s for s in scores if s[2]][:5]:
            fit = [(k, -s) for s, k, alike in scores if not alike and 30 * -p <= 100 * -s <= 90 * -p][:10]
            out += [(anchor, positive, rank, k, -p, s) for rank, (k, s) in enumerate(fit, 1)]
    return sorted(out)


def rows_of(seed, n, width=6, kind="normal"):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(10, width))
    rows = []
    for k in range(n):
        label = int(draw.integers(10))
        vector = centres[label] + draw.normal(size=width) * 0.8
        if kind == "ties":  # few different vectors, zero ones among them
            vector = np.round(vector)
        if kind == "long":  # scores beyond what doubles hold
            vector = np.floor(vector * 1e6)
        rows.append((k, vector.astype(np.float32).tolist(), label))
    return rows


def got(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<float>, label int, `group` string, score int")
    return sorted(map(tuple, hn.hard_negatives(frame.repartition(5)).select(*COLUMNS).collect()))


@pytest.mark.parametrize("kind", ["normal", "ties", "long"])
@pytest.mark.parametrize("sizes", [{}, {"GROUP_ANCHORS": 3, "PER_CENTROID": 2, "MIN_BLOCK_ROWS": 100, "STEP": 8, "MAX_STEP": 16}])
def test_plain_scores(spark, monkeypatch, kind, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(hn, name, value)
    rows = rows_of(3, 900, kind=kind)
    want = plain(rows)
    assert got(spark, rows) == want and len(want) > 100


def test_untidy_rows(spark):
    rows = rows_of(5, 500)
    same = rows[0][1]
    rows += [(600 + k, same, 3) for k in range(40)]  # a common vector
    rows += [rows[100], rows[100], (200, rows[7][1], 9), (None, same, 1), (900, None, 1), (901, same, None)]
    rows += [(1000, [float("nan")] * 6, 1), (1100, [1.0, None, 2.0, 0.0, 0.0, 0.0], 1), (1200, [float("inf")] + [0.0] * 5, 2)]
    rows += [(1300, [], 4), (1301, [0.5, 0.25], 4), (-100, [v * 2 for v in same], 0)]
    assert got(spark, rows) == plain(rows)
    assert got(spark, []) == [] and got(spark, [(100, same, 1)]) == [] and got(spark, [(1, same, 1), (2, same, 2)]) == []


def test_given_table(spark):
    con = duckdb.connect()
    path = "/root/testdata/sf0.01/embeddings.parquet"
    con.execute(f"CREATE VIEW embeddings AS FROM '{path}'")
    found = sorted(map(tuple, hn.hard_negatives(spark.read.parquet(path)).select(*COLUMNS).collect()))
    assert found == sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({hn.SQL})").fetchall())


def test_bounds_hold_and_end_walks_early():
    draw = np.random.default_rng(1)
    vectors = np.floor(draw.normal(size=(4000, 16)) * 256 * np.linspace(3, 0.1, 4000)[:, None])
    norms = np.linalg.norm(vectors, axis=1)
    candidates = {"ids": np.arange(4000), "labels": np.zeros(4000, int), "vectors": vectors, "norms": norms}
    members = {key: value[5:9] for key, value in candidates.items()}
    centroid = vectors[5:9].sum(axis=0)
    requests = hn.Requests(np.arange(4), 5)
    walked, products = [], hn._products
    hn._products = lambda a, b: walked.append(len(b)) or products(a, b)
    try:
        hn.walk(members, candidates, centroid / np.linalg.norm(centroid), requests, True)
    finally:
        hn._products = products
    assert 0 < sum(walked) < 4000
    for k in range(4):
        scores = sorted((-int(vectors[5 + k] @ vectors[j]), j) for j in range(4000) if j != 5 + k)[:5]
        assert [(-s, i) for r, s, i in zip(*requests.found) if r == k] == scores
