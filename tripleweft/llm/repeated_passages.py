"""Substring deduplication with a count-min prefilter.

A passage is a window of 50 consecutive words. Counting every window would
shuffle the corpus many times over, so a first pass counts anchors: the
smallest-hash run of 25 words in each window. Equal windows have equal anchors,
so an anchor occurs at least as often as any window it stands for, and a
count-min sketch of the anchors overestimates window counts. Each partition's
sketch is summed map-side, the partial sketches merge in one shuffle, and the
sketch grows with the corpus. A second pass groups exactly, by 128 bits, only
the windows whose anchor is estimated to be repeated; it loses none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleweft.llm.arrays import U64, Words, slices, windows, within
from tripleweft.llm.runtime import materialize, prepare
from tripleweft.session import broadcast_if_small

WINDOW = 50
_ANCHOR = 25
SKETCH_ROWS, CELLS_PER_ANCHOR = 2, 4
BROADCAST_IDS = 1_000_000  # ids of candidates, 8 bytes each; more of them are joined by a shuffle


def _anchors(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each window within a document, where its smallest run of 25 words starts."""
    runs = windows(hashes, _ANCHOR)
    span = WINDOW - _ANCHOR + 1
    if len(runs) < span:
        return np.zeros(0, np.int64)
    lowest = np.lib.stride_tricks.sliding_window_view(runs, span).argmin(1) + np.arange(len(runs) - span + 1)
    return lowest[within(doc, WINDOW)]


def profile_texts(docs: DataFrame) -> DataFrame:
    """`doc_id, n_words, all_sha256, seq_a, seq_b, anchors` for every row of `doc_id, text`.

    `seq_a, seq_b` are 128 bits of the whole word sequence, `anchors` the
    distinct anchors of its windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = Words(part.column("text"))
            hashes, doc = words.hashes(), words.doc()
            where = _anchors(hashes, doc)
            values, owner = windows(hashes, _ANCHOR)[where], doc[where]
            cut = np.searchsorted(owner, np.arange(words.n_docs + 1))
            found = [np.unique(values[a:b]).view(np.int64) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            joined = [b" ".join(_bytes(words, row).split()) for row in range(words.n_docs)]
            digest = [hashlib.sha256(b) for b in joined]
            pair = np.array([np.frombuffer(d.digest()[:16], np.int64) for d in digest]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), pa.array(words.counts(), pa.int64()), pa.array([d.hexdigest() for d in digest]),
                    pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy()), pa.array(found, pa.list_(pa.int64())),
                ],
                ["doc_id", "n_words", "all_sha256", "seq_a", "seq_b", "anchors"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_words bigint, all_sha256 string, seq_a bigint, seq_b bigint, anchors array<bigint>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _bytes(words: Words, row: int) -> bytes:
    return words.data[words.offsets[row] : words.offsets[row + 1]].tobytes()


def repeated_anchors(anchors: DataFrame) -> DataFrame:
    """The rows `doc_id, anchor` whose count-min estimate is two or more.

    Partial sums per partition are the partition sketches and the shuffle
    merges them; the width follows the number of anchors.
    """
    width = max(1 << 16, CELLS_PER_ANCHOR * anchors.count())

    def cell(row: int) -> Column:  # the rows of the sketch lie one after the other
        return row * width + F.pmod(F.xxhash64(F.lit(row), "anchor"), F.lit(width))

    cells = F.array(*[cell(row) for row in range(SKETCH_ROWS)])
    sketch = anchors.select(F.explode(cells).alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    full = materialize(sketch.where("n > 1").select("cell"), "sketch")
    found = anchors
    for row in range(SKETCH_ROWS):  # the estimate is the least over the rows
        own = full.where(F.col("cell").between(row * width, (row + 1) * width - 1))
        found = found.withColumn("cell", cell(row)).join(own, "cell", "left_semi").drop("cell")
    return found


def _candidate_windows(docs: DataFrame) -> DataFrame:
    """`a, b, doc_id, at` for the windows of `doc_id, text, anchors` that have one of the anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = Words(part.column("text"))
            hashes, doc = words.hashes(), words.doc()
            inside = np.flatnonzero(within(doc, WINDOW))
            anchor = windows(hashes, _ANCHOR)[_anchors(hashes, doc)]
            lists = part.column("anchors")
            owner = np.repeat(np.arange(words.n_docs), np.diff(lists.offsets.to_numpy()))
            listed = lists.flatten().to_numpy().view(U64)
            # an anchor counts for its own document only
            own = np.zeros(len(inside), bool)
            borders = np.searchsorted(doc[inside], np.arange(words.n_docs + 1))
            cut = np.searchsorted(owner, np.arange(words.n_docs + 1))
            for row in range(words.n_docs):
                mine = slice(borders[row], borders[row + 1])
                own[mine] = np.isin(anchor[mine], listed[cut[row] : cut[row + 1]])
            at = inside[own]
            other = words.hashes(1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(windows(hashes, WINDOW)[at].view(np.int64)), pa.array(windows(other, WINDOW, 1)[at].view(np.int64)),
                    part.column("doc_id").take(pa.array(doc[at])), pa.array((at - words.first[doc[at]]).astype(np.int64)),
                ],
                ["a", "b", "doc_id", "at"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text", "anchors").mapInArrow(run, f"a bigint, b bigint, doc_id {kind}, at bigint")


def _cut(docs: DataFrame) -> DataFrame:
    """`doc_id, n_removed, text` of `doc_id, text, starts` without the words of the windows at `starts`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            removed, kept = [], []
            for text, starts in zip(part.column("text").to_pylist(), part.column("starts"), strict=True):
                words = text.encode().split()  # ASCII blanks, just those that separate words
                at = starts.values.to_numpy()
                edges = np.zeros(len(words) + 1, np.int64)
                np.add.at(edges, at, 1)
                np.add.at(edges, at + WINDOW, -1)
                stays = np.cumsum(edges[:-1]) == 0
                removed.append(len(words) - int(stays.sum()))
                kept.append(b" ".join([words[k] for k in np.flatnonzero(stays)]).decode())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_removed", "kept_text"]
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text", "starts").mapInArrow(run, f"doc_id {kind}, n_removed bigint, kept_text string")


def remove_repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`profile, changed`: facts on every row, and the new texts of those that lose words.

    `profile` has `doc_id, n_words, all_sha256, copied` per row of `doc_id,
    text`; a copied row has the word sequence of a smaller doc_id, 50 words or
    more, and loses all. `changed` has `doc_id, n_removed, kept_text` for the
    other documents with a window that starts in a smaller doc_id too.

    Null and empty texts have no words; a null doc_id neither loses words nor
    takes any; rows that repeat a doc_id take none from each other, and rows of
    one doc_id with different texts lose the windows of either. Other columns
    are ignored; an empty table gives empty results.
    """
    prepare(docs.sparkSession)
    facts = materialize(profile_texts(docs), "profile")
    keys = ["seq_a", "seq_b"]
    first = facts.where(F.col("n_words") >= WINDOW).groupBy(*keys).agg(F.min("doc_id").alias("first_id"))
    # the hash beside the keys gives both sides an exchange, so that a text of many copies is split
    spread = F.xxhash64(*keys).alias("_hash")
    profile = facts.select("*", spread).join(first.select("*", spread), [*keys, "_hash"], "left").select(
        "doc_id", "n_words", "all_sha256", F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)).alias("copied")
    )

    # an exact copy has no window that the first of its kind has not
    leaders = first.withColumnRenamed("first_id", "doc_id")
    anchors = facts.select(*keys, "doc_id", "anchors").join(leaders, [*keys, "doc_id"], "left_semi")
    # rows that repeat a doc_id count twice, which can only raise an estimate
    anchors = materialize(anchors.select("doc_id", F.explode("anchors").alias("anchor")), "anchors")
    listed = repeated_anchors(anchors).groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
    listed = materialize(listed, "listed")
    # where the ids are few enough to broadcast, only candidates' texts are shuffled
    few = broadcast_if_small(listed.select("doc_id"), BROADCAST_IDS)
    texts = docs.select("doc_id", "text").where("text IS NOT NULL").join(few, "doc_id", "left_semi")
    texts = materialize(texts.join(listed, "doc_id"), "candidates")

    found = _candidate_windows(texts)
    groups = found.groupBy("a", "b").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    # written, so that the join below has an exchange on both sides and a hot window is split
    groups = materialize(groups.where("first_id < last_id").drop("last_id"), "repeated")
    late = found.join(groups, ["a", "b"]).where("doc_id > first_id")
    starts = late.groupBy("doc_id").agg(F.collect_set("at").alias("starts"))
    return profile, _cut(texts.join(starts, "doc_id"))


def repeat_report(docs: DataFrame) -> DataFrame:
    """`doc_id, n_words, n_removed, kept_sha256` for every row: what `remove_repeats` leaves."""
    profile, changed = remove_repeats(docs)
    cut = changed.select("doc_id", "n_removed", F.sha2("kept_text", 256).alias("cut_sha256")).dropDuplicates(["doc_id"])
    copied = F.col("copied")
    return profile.join(cut, "doc_id", "left").select(
        "doc_id",
        "n_words",
        F.when(copied, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut_sha256", "all_sha256")).alias("kept_sha256"),
    )
