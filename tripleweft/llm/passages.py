"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded, a gated attention
network learned from document labels alone weighs the passages, and the
weighted representation is scored. The networks are trained in numpy on a
bounded sample of labelled documents; scoring streams over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleweft.llm.arrays import U64, Words, mix, slices
from tripleweft.llm.runtime import materialize, prepare

PASSAGE_WORDS = 64
SAMPLE_DOCS = 4000  # labelled documents the classifier is fitted on, at most
SAMPLE_PASSAGES = 200_000  # passages of all of them together, at most: 41 MB of features
THRESHOLD = 0.7
_BUCKETS, _HIDDEN, _GATE = 32, 24, 12
_SYMBOLS = np.zeros(256, np.float32)
_SYMBOLS[np.frombuffer(b"#*$%&|<>@^~_=+{}[]\\", np.uint8)] = 1
_UPPER, _DIGIT, _MARK, _STOP, _LOUD, _HIGH = (np.zeros(256, np.float32) for _ in range(6))
_UPPER[ord("A") : ord("Z") + 1] = 1
_DIGIT[ord("0") : ord("9") + 1] = 1
_MARK[np.frombuffer(b",;:'\"()-/", np.uint8)] = 1
_STOP[ord(".")] = 1
_LOUD[np.frombuffer(b"!?", np.uint8)] = 1
_HIGH[128:] = 1
_CLASSES = (_SYMBOLS, _UPPER, _DIGIT, _MARK, _STOP, _LOUD, _HIGH)
N_FEATURES = 2 * len(_CLASSES) + 6 + _BUCKETS


def encode_passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """`first, features`: the passages of all texts and each text's first one.

    A passage is 64 consecutive words, the last one shorter. A text without
    words is one passage of zeros.
    """
    words = Words(texts)
    counts = words.counts()
    n_passages = np.maximum(1, -(-counts // PASSAGE_WORDS))
    first = np.concatenate([[0], np.cumsum(n_passages)])
    out = np.zeros((first[-1], N_FEATURES), np.float32)
    if not len(words.starts):
        return first, out
    doc = words.doc()
    passage = first[doc] + (np.arange(len(doc)) - words.first[doc]) // PASSAGE_WORDS
    lead = np.flatnonzero(np.diff(passage, prepend=-1))
    at = passage[lead]
    size = np.diff(np.append(lead, len(doc))).astype(np.float32)

    length = (words.ends - words.starts).astype(np.float32)
    begin = np.cumsum(words.ends - words.starts) - (words.ends - words.starts)
    inside = words.data[words.inside]
    n_bytes = np.add.reduceat(length, lead)
    column = 0
    for chars in _CLASSES:  # the share of bytes, and of words with one
        per_word = np.add.reduceat(chars[inside], begin)
        out[at, column] = np.add.reduceat(per_word, lead) / n_bytes
        out[at, column + 1] = np.add.reduceat((per_word > 0).astype(np.float32), lead) / size
        column += 2
    hashes = words.hashes()
    order = np.lexsort((hashes, passage))
    fresh = np.ones(len(doc), np.float32)
    fresh[1:] = (np.diff(passage[order]) != 0) | (hashes[order][1:] != hashes[order][:-1])
    out[at, column] = np.add.reduceat(fresh, lead) / size  # distinct words
    again = np.zeros(len(doc), np.float32)
    again[1:] = hashes[1:] == hashes[:-1]
    out[at, column + 1] = np.add.reduceat(again, lead) / size
    out[at, column + 2] = n_bytes / size / 10
    out[at, column + 3] = np.sqrt(np.maximum(np.add.reduceat(length**2, lead) / size - (n_bytes / size) ** 2, 0)) / 10
    out[at, column + 4] = np.add.reduceat((length == 1).astype(np.float32), lead) / size
    out[at, column + 5] = np.log1p(size) / 5
    column += 6
    spread = mix(hashes, 5)
    bucket = (spread % U64(_BUCKETS)).astype(np.int64)
    sign = np.where(spread >> U64(63), 1.0, -1.0).astype(np.float32)
    cell = np.bincount(passage * _BUCKETS + bucket, sign, minlength=first[-1] * _BUCKETS).reshape(-1, _BUCKETS)
    out[at, column:] = cell[at] / np.sqrt(size)[:, None] / 4
    return first, out


@dataclass
class AttentionModel:
    """Passage encoder, gated attention and document score; float64 weights by name."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def forward(self, first: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
        w, lead = self.weights, first[:-1]
        bag = np.repeat(np.arange(len(lead)), np.diff(first))
        x = (x - w["mean"]) / w["scale"]
        h = np.tanh(x @ w["W"] + w["b"])
        tanh, gate = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        raw = (tanh * gate) @ w["a"]
        attention = np.exp(raw - np.maximum.reduceat(raw, lead)[bag])
        attention /= np.add.reduceat(attention, lead)[bag]
        z = np.add.reduceat(attention[:, None] * h, lead)
        score = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["d"], -30, 30)))
        return {"x": x, "h": h, "tanh": tanh, "gate": gate, "attention": attention, "z": z, "bag": bag, "score": score}

    def gradients(self, first: np.ndarray, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, s, lead = self.weights, self.forward(first, x), first[:-1]
        out = (s["score"] - y) / len(y)
        dz = out[:, None] * w["c"]
        dz_bag = dz[s["bag"]]
        along = (s["h"] * dz_bag).sum(1)
        d_raw = s["attention"] * (along - np.add.reduceat(s["attention"] * along, lead)[s["bag"]])
        d_tanh = d_raw[:, None] * w["a"] * s["gate"] * (1 - s["tanh"] ** 2)
        d_gate = d_raw[:, None] * w["a"] * s["tanh"] * s["gate"] * (1 - s["gate"])
        dh = s["attention"][:, None] * dz_bag + d_tanh @ w["V"].T + d_gate @ w["U"].T
        dh *= 1 - s["h"] ** 2
        return {
            "W": s["x"].T @ dh, "b": dh.sum(0), "V": s["h"].T @ d_tanh, "U": s["h"].T @ d_gate,
            "a": (s["tanh"] * s["gate"]).T @ d_raw, "c": s["z"].T @ out, "d": out.sum(),
        }

    @classmethod
    def fit(cls, bags: list[np.ndarray], labels: np.ndarray, epochs: int = 40, rate: float = 0.01) -> AttentionModel:
        """Adam on the log loss of document labels, from a fixed seed."""
        rng = np.random.default_rng(7)
        every = np.concatenate(bags) if bags else np.zeros((1, N_FEATURES))

        def draw(*shape: int) -> np.ndarray:
            return rng.normal(0, 1 / np.sqrt(shape[0]), shape)

        prior = np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99)
        w = {"W": draw(N_FEATURES, _HIDDEN), "b": np.zeros(_HIDDEN), "V": draw(_HIDDEN, _GATE), "U": draw(_HIDDEN, _GATE),
             "a": draw(_GATE), "c": draw(_HIDDEN), "d": np.log(prior / (1 - prior))}
        model = cls(w | {"mean": every.mean(0, dtype=np.float64), "scale": every.std(0, dtype=np.float64) + 0.02})
        moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
        step = 0
        for epoch in range(epochs if bags else 0):
            order = rng.permutation(len(bags))
            for batch in np.array_split(order, max(1, len(order) // 64)):
                first = np.concatenate([[0], np.cumsum([len(bags[k]) for k in batch])])
                gradients = model.gradients(first, np.concatenate([bags[k] for k in batch]), labels[batch])
                step += 1
                for k, g in gradients.items():
                    g = g + 1e-4 * model.weights[k] * (k in "WVU")
                    m, v = (0.9 * moment[k][0] + 0.1 * g, 0.999 * moment[k][1] + 0.001 * g * g)
                    moment[k] = (m, v)
                    pace = rate * (1 - epoch / epochs) / (1 - 0.9**step) * np.sqrt(1 - 0.999**step)
                    model.weights[k] = model.weights[k] - pace * m / (np.sqrt(v) + 1e-8)
        return model


def _fold(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4))


def train_quality(docs: DataFrame, labels: DataFrame, max_docs: int = SAMPLE_DOCS, max_passages: int = SAMPLE_PASSAGES) -> AttentionModel:
    """A model fitted on every passage of labelled documents outside the held-out fold.

    The fold is `crc32(doc_id) mod 4 = 2`. Of the others, the `max_docs` with
    the smallest hash of doc_id are used, in that order, but for those with
    which the passages would exceed `max_passages`; the two bounds are what
    reaches the driver. A document with several labels has their mean, rounded;
    rows that repeat a doc_id with other passages count as documents of their
    own, others once; null texts are empty ones; null labels and ids are
    skipped; without any label every score is about one half.
    """
    spark = prepare(docs.sparkSession)
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (_fold(F.col("doc_id")) != 2))
    sample = (
        known.groupBy("doc_id")
        .agg(F.avg("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_docs)
        .select("doc_id", (F.col("quality") >= 0.5).cast("int").alias("quality"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            first, x = encode_passages(part.column("text"))
            passages = [x[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.string()), part.column("quality"), pa.array(np.diff(first)), pa.array(passages, pa.large_binary())],
                ["doc_id", "quality", "n", "passages"],
            )

    # at most max_docs rows, so the broadcast is bounded
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "quality")
    found = found.mapInArrow(run, "doc_id string, quality int, n bigint, passages binary").withColumn("content", F.xxhash64("passages"))
    found = materialize(found, "passages")
    order = [F.xxhash64("doc_id"), "doc_id", "content"]
    total, picked = 0, []
    for r in found.select("doc_id", "content", "n").distinct().orderBy(*order).limit(max_docs).collect():
        if total + r["n"] <= max_passages:
            total += r["n"]
            picked.append((r["doc_id"], r["content"]))
    chosen = F.broadcast(spark.createDataFrame(picked, "doc_id string, content bigint"))
    rows = found.join(chosen, ["doc_id", "content"]).dropDuplicates(["doc_id", "content"]).collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["content"]))
    bags = [np.frombuffer(r["passages"], np.float32).reshape(-1, N_FEATURES) for r in rows]
    return AttentionModel.fit(bags, np.array([r["quality"] for r in rows], float))


def _scores(model: AttentionModel, part: pa.RecordBatch) -> np.ndarray:
    first, x = encode_passages(part.column("text"))
    return np.round(model.forward(first, x)["score"], 9)  # the last bits depend on a batch's other rows


def score_quality(docs: DataFrame, model: AttentionModel) -> DataFrame:
    """`doc_id, score` for every row of `doc_id, text`; the text alone is scored.

    Null and empty texts are scored as one passage of zeros, a null doc_id
    stays null, equal texts have equal scores, other columns are ignored.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(_scores(model, part))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def keep_quality(docs: DataFrame, model: AttentionModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, with all columns, whose score reaches `threshold`."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield part.filter(pa.array(_scores(model, part) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score, fold and prediction of every document by a model trained here."""
    return score_quality(docs, train_quality(docs, labels)).select(
        "doc_id",
        (F.coalesce(_fold(F.col("doc_id")), F.lit(0)) == 2).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
