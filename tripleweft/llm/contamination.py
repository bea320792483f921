"""Benchmark decontamination by size-partitioned MinHash containment search.

A short item hides in a long document, where the Jaccard similarity of the two
is tiny. Items are therefore partitioned by size, and for each size class a
document is cut into overlapping windows of that scale, so that a contained
item has a similarity of a third or more with some window. One-permutation
MinHash bins of items and windows that agree make a candidate; candidates are
verified by exact containment of the item's shingles in the whole document.

Items of a bounded size are broadcast and the documents stream past them. More
items are joined with the documents' minima by shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleweft.llm.arrays import U64, Words, mix, shingles, slices
from tripleweft.llm.runtime import materialize, prepare

CONTAINMENT = 0.75
BROADCAST_ITEMS = 50_000  # items that are broadcast; more of them are joined
BROADCAST_BYTES = 64 << 20  # and their shingles
BINS, SMALL_BINS, SMALLEST = 256, 4096, 8
_GATE_BITS = 22
_JOIN_GATE_BITS = 27  # bits of the gate that documents pass before a join: 16 MB, however many items


def _size_class(n_words: np.ndarray) -> np.ndarray:
    """The power of two that holds the item, 8 at least."""
    return np.maximum(SMALLEST, 2 ** np.ceil(np.log2(np.maximum(n_words, 1))).astype(np.int64))


def _bin(values: np.ndarray, size: int) -> np.ndarray:
    bins = SMALL_BINS if size == SMALLEST else BINS
    return ((mix(values, 11) >> U64(32)) * U64(bins)) >> U64(32)


def _minima(own: np.ndarray, size: int) -> np.ndarray:
    """The smallest shingle of each bin that has one."""
    bins = _bin(own, size)
    order = np.lexsort((own, bins))
    return own[order[np.flatnonzero(np.diff(bins[order].astype(np.int64), prepend=-1))]]


def _windows(own: np.ndarray, hits: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The windows of `2 * size` shingles, one every `size`, that hold one of `hits`.

    A shingle lies in two of them.
    """
    for window in np.unique(np.concatenate([hits // size, hits // size - 1])) if len(hits) else ():
        yield own[max(window, 0) * size : (window + 2) * size]


def shingle_items(items: DataFrame) -> DataFrame:
    """`item_id, n_words, shingles` with the distinct shingle hashes of each item row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = Words(part.column("text"), lower=True)
            first, values = shingles(words, words.hashes())
            sets = [np.unique(values[a:b]).view(np.int64) for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("item_id"), pa.array(words.counts(), pa.int64()), pa.array(sets, pa.list_(pa.int64()))],
                ["item_id", "n_words", "shingles"],
            )

    kind = dict(items.dtypes)["item_id"]
    schema = f"item_id {kind}, n_words bigint, shingles array<bigint>"
    return items.select("item_id", "text").mapInArrow(run, schema)


class _Index:
    """Signatures of one block of items by size class, with the exact shingle sets."""

    def __init__(self, rows: list) -> None:
        self.ids = [row["item_id"] for row in rows]
        self.sets = [np.array(row["shingles"], np.int64).view(U64) for row in rows]
        size = _size_class(np.array([row["n_words"] for row in rows], np.int64))
        self.signatures: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for c in np.unique(size):
            values, items = [], []
            for k in np.flatnonzero(size == c):
                values.append(_minima(self.sets[k], c))
                items.append(np.full(len(values[-1]), k))
            value, item = np.concatenate(values), np.concatenate(items)
            order = np.argsort(value, kind="stable")
            self.signatures[int(c)] = value[order], item[order]
        every = np.concatenate([v for v, _ in self.signatures.values()] or [np.zeros(0, U64)])
        self.gate = np.zeros(1 << _GATE_BITS, bool)
        self.gate[every >> U64(64 - _GATE_BITS)] = True

    def search(self, own: np.ndarray) -> set[int]:
        """Items that share a bin minimum with a window of the document's shingles.

        Of the smallest items any shingle that equals a minimum is enough.
        """
        gated = np.flatnonzero(self.gate[own >> U64(64 - _GATE_BITS)])
        found: set[int] = set()
        for c, (values, items) in self.signatures.items() if len(gated) else ():
            at = np.searchsorted(values, own[gated])
            hit = gated[(at < len(values)) & (values[np.minimum(at, len(values) - 1)] == own[gated])]
            for lead in [np.unique(own[hit])] if c == SMALLEST else (_minima(part, c) for part in _windows(own, hit, c)):
                low, high = np.searchsorted(values, lead, "left"), np.searchsorted(values, lead, "right")
                for a, b in zip(low[high > low], high[high > low], strict=True):
                    found.update(items[a:b].tolist())
        return found


def _hits(index: _Index, part: pa.RecordBatch, threshold: float) -> Iterator[tuple[int, int, int]]:
    """`row, item, shared` for each document of the slice that contains an item."""
    words = Words(part.column("text"), lower=True)
    first, values = shingles(words, words.hashes())
    gated = np.flatnonzero(index.gate[values >> U64(64 - _GATE_BITS)])
    for row in np.unique(np.searchsorted(first, gated, "right") - 1):
        own = values[first[row] : first[row + 1]]
        candidates = index.search(own)
        distinct = np.unique(own) if candidates else own
        for k in sorted(candidates):
            at = np.minimum(np.searchsorted(distinct, index.sets[k]), len(distinct) - 1)
            shared = int((distinct[at] == index.sets[k]).sum())
            if shared >= threshold * len(index.sets[k]):
                yield int(row), k, shared


def _item_sets(items: DataFrame) -> tuple[DataFrame, bool]:
    """The items' numbered shingle sets, and whether they may be broadcast."""
    sets = shingle_items(items).where(F.size("shingles") > 0)
    sets = materialize(sets.withColumn("item", F.monotonically_increasing_id()), "items")
    n_items, n_shingles = sets.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("shingles")), F.lit(0))).first()
    return sets, n_items <= BROADCAST_ITEMS and 8 * n_shingles <= BROADCAST_BYTES


def _signatures(sets: DataFrame) -> DataFrame:
    """`item, size, value`: the bin minima of each item; the smallest items have size 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = _size_class(np.array(batch.column("n_words"), np.int64)) if batch.num_rows else []
            for item, c, own in zip(batch.column("item"), size, batch.column("shingles"), strict=True):
                minima = _minima(np.array(own.values, np.int64).view(U64), c).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(minima), item.as_py())), pa.array(np.full(len(minima), 0 if c == SMALLEST else c)),
                        pa.array(minima),
                    ],
                    ["item", "size", "value"],
                )

    return sets.select("item", "n_words", "shingles").mapInArrow(run, "item bigint, size bigint, value bigint")


def _join_gate(sets: DataFrame) -> Broadcast:
    """Which leading bits the items' shingles have, as a bit table of a fixed size."""
    places = sets.select(F.explode("shingles").alias("value")).select(F.shiftrightunsigned("value", 64 - _JOIN_GATE_BITS).alias("place"))
    marks = places.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 AS int))")).alias("bits"))
    table = marks.toArrow()
    gate = np.zeros(1 << _JOIN_GATE_BITS - 6, np.int64)
    gate[np.array(table.column("word"))] = np.array(table.column("bits"))
    return sets.sparkSession.sparkContext.broadcast(gate.view(U64))


def _passes(gate: np.ndarray, values: np.ndarray) -> np.ndarray:
    place = values >> U64(64 - _JOIN_GATE_BITS)
    return (gate[place >> U64(6)] >> (place & U64(63)) & U64(1)).astype(bool)


def _document_keys(docs: DataFrame, gate: Broadcast, sizes: list[int]) -> DataFrame:
    """`row, doc_id, size, value` of what may occur in an item.

    Size 0 has the document's distinct shingles, the others the bin minima of
    its windows of that size. Every document is cut into shingles once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = Words(part.column("text"), lower=True)
            first, values = shingles(words, words.hashes())
            passed = np.flatnonzero(_passes(gate.value, values))
            for row in np.unique(np.searchsorted(first, passed, "right") - 1):
                own = values[first[row] : first[row + 1]]
                hits = np.flatnonzero(_passes(gate.value, own))
                keys = {0: np.unique(own[hits])}
                for c in sizes:
                    minima = np.unique(np.concatenate([_minima(w, c) for w in _windows(own, hits, c)]))
                    keys[c] = minima[_passes(gate.value, minima)]
                n = [len(v) for v in keys.values()]
                at = pa.array(np.full(sum(n), row))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row").take(at), part.column("doc_id").take(at),
                        pa.array(np.repeat(np.array([*keys], np.int64), n)), pa.array(np.concatenate([*keys.values()]).view(np.int64)),
                    ],
                    ["row", "doc_id", "size", "value"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("row", "doc_id", "text").mapInArrow(run, f"row bigint, doc_id {kind}, size bigint, value bigint")


def _joined(docs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """`row, doc_id, item_id, n_shared, containment`; `docs` has a column `row` of distinct numbers.

    Documents and items meet on equal minima, and a candidate's shared shingles
    are counted by a join on the shingles of both. Nothing passes the driver
    but the gate, whose size is fixed. Both sides of every join have an
    exchange, so that adaptive execution can split a frequent shingle.
    """
    signatures = materialize(_signatures(sets), "item-signatures")
    sizes = [r["size"] for r in signatures.where("size > 0").select("size").distinct().collect()]
    keys = materialize(_document_keys(docs, _join_gate(sets), sizes), "document-keys")
    candidates = materialize(keys.join(signatures, ["size", "value"]).select("row", "item").distinct(), "item-candidates")
    wanted = candidates.join(sets.select("item", "item_id", F.size("shingles").alias("n"), F.explode("shingles").alias("value")), "item")
    shared = wanted.join(keys.where("size = 0"), ["row", "value"]).groupBy("row", "doc_id", "item", "item_id", "n")
    found = shared.agg(F.count(F.lit(1)).alias("n_shared")).where(F.col("n_shared") >= threshold * F.col("n"))
    return found.select("row", "doc_id", "item_id", "n_shared", (F.col("n_shared") / F.col("n")).alias("containment"))


def find_contamination(docs: DataFrame, items: DataFrame, threshold: float = CONTAINMENT) -> DataFrame:
    """`doc_id, item_id, n_shared, containment` for each item a document contains.

    Containment is the part of the item's distinct 5-word shingles, lower case
    for A-Z, that occur in the whole document; a pair is returned from
    `threshold` on. Items up to `BROADCAST_ITEMS` and `BROADCAST_BYTES` are
    broadcast and nothing is shuffled; more are joined by shuffles.

    An item without words matches nothing. One with fewer than five words is
    one shingle, its whole sequence, so only a text of just these words
    contains it. Null texts contain nothing; null ids stay null; repeated rows
    of either side each give their pairs; other columns are ignored; empty
    tables give an empty result.
    """
    spark = prepare(docs.sparkSession)
    sets, small = _item_sets(items)
    if not small:
        rows = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
        return _joined(rows, sets, threshold).drop("row")
    doc_kind, item_kind = dict(docs.dtypes)["doc_id"], dict(items.dtypes)["item_id"]
    schema = f"doc_id {doc_kind}, item_id {item_kind}, n_shared bigint, containment double"
    item_type = sets.limit(0).toArrow().schema.field("item_id").type
    index = spark.sparkContext.broadcast(_Index(sets.collect()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            hits = list(_hits(index.value, part, threshold))
            sizes = [len(index.value.sets[k]) for _, k, _ in hits]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").take(pa.array([r for r, _, _ in hits], pa.int64())),
                    pa.array([index.value.ids[k] for _, k, _ in hits], item_type),
                    pa.array([n for _, _, n in hits], pa.int64()),
                    pa.array([h[2] / n for h, n in zip(hits, sizes, strict=True)], pa.float64()),
                ],
                ["doc_id", "item_id", "n_shared", "containment"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = CONTAINMENT) -> DataFrame:
    """The rows of `docs` that contain no item, with all their columns.

    Each row is judged by its own text: repeated rows alike, null and empty
    texts stay. Items that may be broadcast are filtered out while the
    documents stream by; with more items the rows are numbered and written
    once, and those found are taken out by an anti join.
    """
    spark = prepare(docs.sparkSession)
    sets, small = _item_sets(items)
    if small:
        return docs.mapInArrow(_keep_clean(spark.sparkContext.broadcast(_Index(sets.collect())), threshold), docs.schema)
    number = "_row"
    while number in docs.columns:
        number += "_"
    rows = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    found = _joined(rows.select(F.col(number).alias("row"), "doc_id", "text"), sets, threshold)
    dirty = materialize(found.select(F.col("row").alias(number)).distinct(), "contaminated")
    return rows.join(dirty, number, "left_anti").select(*docs.columns)


def _keep_clean(index, threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            clean = np.ones(part.num_rows, bool)
            clean[[row for row, _, _ in _hits(index.value, part, threshold)]] = False
            yield part.filter(pa.array(clean))

    return run
