"""MinHash near-duplicate groups: one-permutation hashing with optimal densification.

Each text's distinct word shingles are hashed once and dealt to bins by their
hash; a bin keeps its smallest. Empty bins borrow from others in an order drawn
per bin, the same for all texts. Bins form bands, and equal bands put texts in
one bucket. A bucket gives star-shaped edges, each member to its hub, so pairs
grow with the members. Edges are confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleweft.llm.arrays import SHINGLE, U64, Words, mix, shingles, slices
from tripleweft.llm.components import connected_components
from tripleweft.llm.runtime import materialize, prepare
from tripleweft.session import broadcast_if_small

PERCENT = 75  # least similarity of linked texts
BANDS, ROWS = 40, 5  # two texts at 0.75 share no band with a chance of 2 in 100,000
BROADCAST_IDS = 1_000_000  # ids of candidates, 8 bytes each; more of them are joined by a shuffle
_BINS = BANDS * ROWS


@cache
def _borrowing() -> np.ndarray:
    """For each bin the order in which it tries others: a permutation of its own."""
    rng = np.random.default_rng(11)
    return np.array([rng.permutation(_BINS) for _ in range(_BINS)])


def signature(values: np.ndarray) -> np.ndarray:
    """The densified bins of the sorted, distinct, mixed shingle hashes of one text."""
    bins = ((values >> U64(32)) * U64(_BINS) >> U64(32)).astype(np.int64)
    lead = np.flatnonzero(np.diff(bins, prepend=-1))
    out = np.zeros(_BINS, U64)
    full = np.zeros(_BINS, bool)
    out[bins[lead]] = values[lead]
    full[bins[lead]] = True
    empty = np.flatnonzero(~full)
    if len(empty):
        order = _borrowing()[empty]
        out[empty] = out[order[np.arange(len(empty)), full[order].argmax(1)]]
    return out


def bands(signatures: np.ndarray) -> np.ndarray:
    """One hash per band, different for different bands."""
    parts = signatures.reshape(-1, BANDS, ROWS)
    total = np.zeros(parts.shape[:2], U64)
    for k in range(ROWS):
        total = mix(total * U64(3) + parts[:, :, k], k)
    return mix(total + np.arange(BANDS, dtype=U64), 99)


def _sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(texts, lower=True)
    first, values = shingles(words, words.hashes(), SHINGLE)
    values = mix(values, 3)
    return [np.unique(values[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]


def minhash_bands(docs: DataFrame) -> DataFrame:
    """`doc_id, n_shingles, set_a, set_b, bands` for every row of `doc_id, text`.

    `set_a, set_b` are 128 bits of the set, whatever the order of its members.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = _sets(part.column("text"))
            rows = [(len(s), int(mix(s, 21).sum(dtype=U64)), int(mix(s, 22).sum(dtype=U64))) for s in sets]
            sizes, key_a, key_b = zip(*rows, strict=True)
            found = [bands(signature(s)[None])[0].view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(np.array(key_a, U64).view(np.int64)),
                    pa.array(np.array(key_b, U64).view(np.int64)), pa.array(found, pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "set_a", "set_b", "bands"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def measure(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """`a, b, n_a, n_b, shared, added` for pairs `a, b`, on their full shingle sets.

    `added` are the hashes that `b` has and `a` has not. `texts` has `doc_id,
    text`; the texts are joined, as they are smaller than their sets, and a
    hub's partners are split over tasks.
    """
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text_a"):
            mine, theirs = _sets(part.column("text_a")), _sets(part.column("text_b"))
            added = [np.setdiff1d(y, x, assume_unique=True) for x, y in zip(mine, theirs, strict=True)]
            n_a, n_b, n_added = ([len(s) for s in sets] for sets in (mine, theirs, added))
            yield pa.RecordBatch.from_arrays(
                [
                    *part.select(["a", "b"]).columns, pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()),
                    pa.array(np.subtract(n_b, n_added), pa.int64()), pa.array([x.view(np.int64) for x in added], pa.list_(pa.int64())),
                ],
                ["a", "b", "n_a", "n_b", "shared", "added"],
            )

    kind = dict(texts.dtypes)["doc_id"]
    schema = f"a {kind}, b {kind}, n_a bigint, n_b bigint, shared bigint, added array<bigint>"
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, schema)


def _similar(percent: int) -> Column:
    return 100 * F.col("shared") >= percent * (F.col("n_a") + F.col("n_b") - F.col("shared"))


def _across(placed: DataFrame, measured: DataFrame, percent: int) -> DataFrame:
    """The pairs `a < b` of different components in one bucket that may be linked.

    `placed` has `bucket, hub, node, component, n, shared`, with `shared` the
    size of a member's intersection with its hub. Two members either share
    something the hub has not, and are found by that, or their intersection
    lies in the hub's set and is at most the smaller of theirs with it. Pairs
    for which this bound is too small are not made.
    """
    alike = placed.where(100 * F.col("shared") >= percent * F.col("n"))
    other = alike.select(F.col("bucket").alias("other_bucket"), *[F.col(c).alias("other_" + c) for c in ("node", "component", "n", "shared")])
    bound = (100 + percent) * F.least("shared", "other_shared") >= percent * (F.col("n") + F.col("other_n"))
    inside = alike.join(other, F.expr("bucket = other_bucket AND component < other_component") & bound)
    inside = inside.select(F.least("node", "other_node").alias("a"), F.greatest("node", "other_node").alias("b"))

    members = placed.select("hub", "node", "component", "n", "shared").distinct()
    beyond = measured.select(F.col("a").alias("hub"), F.col("b").alias("node"), F.explode("added").alias("shingle"))
    beyond = beyond.join(members, ["hub", "node"])
    held = beyond.groupBy("hub", "shingle").agg(
        F.min("component").alias("low"), F.max("component").alias("high"),
        F.count(F.lit(1)).alias("holders"), F.bit_xor(F.xxhash64("node")).alias("who"),
    ).where("low < high")
    # an edit changes several shingles; those that the same members hold are one key
    key = ["hub", "holders", "who"]
    beyond = beyond.join(held.select("shingle", *key), ["hub", "shingle"])
    beyond = materialize(beyond.groupBy(*key, "node", "component", "n", "shared").agg(F.count(F.lit(1)).alias("k")), "beyond")
    # what two members share beyond the hub is at most what either shares with anyone there
    common = beyond.groupBy("hub", "node").agg(F.sum("k").alias("common"))
    beyond = beyond.join(common, ["hub", "node"])
    partner = beyond.select(*key, *[F.col(c).alias("other_" + c) for c in ("node", "component", "n", "shared", "common")])
    most = F.least("shared", "other_shared") + F.least("common", "other_common")
    fit = F.expr("component < other_component") & ((100 + percent) * most >= percent * (F.col("n") + F.col("other_n")))
    outside = beyond.join(partner, key).where(fit)
    outside = outside.select(F.least("node", "other_node").alias("a"), F.greatest("node", "other_node").alias("b"))
    return inside.unionByName(outside).distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """`doc_id, n_shingles, component_id, kept` for every row of `doc_id, text`.

    Texts with equal sets form a class, and one member stands for it. Buckets
    give star edges to the member with most company; where a bucket still holds
    several components, the pairs across them that the hub does not rule out
    are tried too, so a hub that resembles nobody loses no link. Components are those of the confirmed
    links; the smallest doc_id stays.

    Texts without words, and null ones, have no shingles and are linked with
    nothing; a null doc_id is linked with nothing and kept. Rows that repeat a
    doc_id are one node: each is linked if its own text is. Other columns are
    ignored and an empty table gives an empty result.
    """
    return _labelled(docs, percent).drop("set_a", "set_b")


def _labelled(docs: DataFrame, percent: int) -> DataFrame:
    """`near_duplicates` with `set_a, set_b`, the hashes of each row's set of shingles."""
    prepare(docs.sparkSession)
    signed = materialize(minhash_bands(docs), "signatures")
    keys = ["set_a", "set_b"]
    classes = materialize(
        signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*keys).agg(F.min("doc_id").alias("node")), "classes"
    )
    nodes = signed.join(classes.withColumnRenamed("node", "doc_id"), [*keys, "doc_id"])
    members = nodes.select(F.col("doc_id").alias("node"), "n_shingles", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialize(members.join(sizes, "bucket"), "buckets")
    # the hub is the member with most company: of near copies, most likely the text they were made from
    company = shared.groupBy("node").agg(F.sum("n").alias("company"))
    hubs = shared.join(company, "node").groupBy("bucket").agg(F.max(F.struct("company", "node")).alias("hub"))
    placed = materialize(shared.join(hubs.select("bucket", F.col("hub.node").alias("hub")), "bucket").where("node <> hub"), "placed")
    stars = materialize(placed.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    ends = materialize(stars.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ends")
    ends = broadcast_if_small(ends, BROADCAST_IDS)
    texts = materialize(docs.select("doc_id", "text").join(ends, "doc_id", "left_semi"), "candidates")
    measured = materialize(measure(stars, texts), "measured")
    links = measured.where(_similar(percent)).select("a", "b")
    labels = materialize(connected_components(links), "components")

    # members of one bucket but several components
    to_hub = measured.groupBy(F.col("a").alias("hub"), F.col("b").alias("node")).agg(F.max("shared").alias("shared"))
    placed = placed.select("bucket", "hub", "node", F.col("n_shingles").alias("n")).join(to_hub, ["hub", "node"])
    placed = placed.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    placed = materialize(placed.join(mixed.select("bucket"), "bucket", "left_semi"), "mixed")
    more = measure(_across(placed, measured, percent), texts)
    more = materialize(more.where(_similar(percent)).select("a", "b"), "confirmed")
    if not more.isEmpty():
        labels = materialize(connected_components(links.unionByName(more)), "components")

    named = classes.join(labels, "node", "left").select(*keys, F.coalesce("component", "node").alias("component"))
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return (
        signed.select("doc_id", "n_shingles", *keys)
        .join(named, keys, "left")
        .select("doc_id", "n_shingles", *keys, F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def keep_first(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs`, with all columns, that stay: one document of each group.

    Each row is judged by its own text: of rows that repeat a doc_id with
    different texts some may stay, and of those with equal sets of shingles one
    stays. Rows without words and rows without a doc_id all stay; an empty
    table gives no rows.
    """
    labelled = materialize(_labelled(docs, percent), "labels")
    by_id = labelled.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if("kept").alias("stay"))
    once = docs.join(by_id.where("rows > 1 OR stay = 0").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    repeated = materialize(by_id.where("rows > 1 AND stay > 0").select("doc_id"), "repeated-ids")
    if repeated.isEmpty():
        return once
    numbered = docs.join(repeated, "doc_id", "left_semi").withColumn("_row", F.monotonically_increasing_id())
    rows = materialize(numbered, "repeated-rows")
    sets = minhash_bands(rows.select(F.col("_row").alias("doc_id"), "text")).withColumnRenamed("doc_id", "_row")
    key = ["doc_id", "set_a", "set_b"]
    stays = rows.select("_row", "doc_id").join(sets.select("_row", "n_shingles", "set_a", "set_b"), "_row")
    stays = stays.join(labelled.where("kept").select(*key).distinct(), key)
    first = stays.where("n_shingles > 0").groupBy(*key).agg(F.min("_row").alias("_row")).select("_row")
    first = first.unionByName(stays.where("n_shingles = 0").select("_row"))
    return once.unionByName(rows.join(first, "_row", "left_semi").select(*docs.columns))
