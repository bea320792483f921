"""Words, hashes and shingles of whole Arrow batches of texts, as numpy arrays.

A batch's texts lie in one UTF-8 buffer. Word borders, word hashes and window
hashes are computed for the whole buffer at once; a window never crosses a
document. Hashes are 64-bit and equal on every machine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SHINGLE = 5
_SLICE_BYTES = 4 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _table(chars: bytes, value: bool) -> np.ndarray:
    table = np.full(256, not value)
    table[np.frombuffer(chars, np.uint8)] = value
    return table


BLANK_SEPARATED = _table(b" \t\n\x0b\x0c\r", False)
ALPHANUMERIC = _table(bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80)), False)


def letter_table() -> np.ndarray:
    """Bytes of letters and of characters beyond ASCII."""
    return _table(bytes(range(0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80)), False)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a slice holds a few MB of text or one document."""
    for batch in batches:
        if batch.num_rows:
            size = np.diff(_offsets(batch.column(column)))
            cut = np.cumsum(size) // _SLICE_BYTES
            starts = [0, *(np.flatnonzero(np.diff(cut)) + 1), batch.num_rows]
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                yield batch.slice(a, b - a)


def _offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    found = np.frombuffer(texts.buffers()[1] or b"", kind)[texts.offset : texts.offset + len(texts) + 1]
    return found.astype(np.int64) if len(found) else np.zeros(1, np.int64)


class Words:
    """`data`, the bytes; `starts`, `ends` of words in it; `first` word of each document."""

    def __init__(self, texts: pa.Array, word: np.ndarray = BLANK_SEPARATED, lower: bool = False):
        if texts.null_count:
            texts = texts.fill_null("")
        offsets = _offsets(texts)
        buffer = texts.buffers()[2]
        data = np.frombuffer(buffer or b"", np.uint8)[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        self.data = LOWER[data] if lower else data
        self.inside = word[self.data]
        begins = self.inside.copy()
        begins[1:] &= ~self.inside[:-1]
        closes = self.inside.copy()
        closes[:-1] &= ~self.inside[1:]
        if len(data):  # words end where documents do
            edges = self.offsets[1:-1]
            edges = edges[(edges > 0) & (edges < len(data))]
            begins[edges] = self.inside[edges]
            closes[edges - 1] = self.inside[edges - 1]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.n_docs = len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(self.n_docs), self.counts())

    def numbered(self) -> pa.DictionaryArray:
        """All words, numbered by their distinct bytes."""
        offsets = np.concatenate([[0], np.cumsum(self.ends - self.starts)])
        data = np.ascontiguousarray(self.data[self.inside])
        buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, buffers).dictionary_encode()

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial in its bytes, mixed."""
        if not len(self.starts):
            return np.zeros(0, U64)
        length = self.ends - self.starts
        begin = np.cumsum(length) - length
        power = powers(int(length.max()), _MULTIPLIER ^ (seed * 0x10001 << 8))
        at = np.arange(length.sum()) - np.repeat(begin, length)
        terms = (self.data[self.inside].astype(U64) + U64(1)) * power[at]
        return mix(np.add.reduceat(terms, begin) + length.astype(U64), seed)


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(max(n, 1), (base | 1) & _MASK, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x + U64((seed + 1) * 0xD1B54A32D192ED03 & _MASK)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def windows(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of every `k` consecutive word hashes, by doubling."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    base = 0xA0761D6478BD642F ^ (seed * 2)
    total, covered, block, size = np.zeros(n, U64), 0, hashes, 1
    while True:
        if k & size:
            total = total * U64(pow(base, size, 1 << 64)) + block[covered : covered + n]
            covered += size
        if covered == k:
            return mix(total, seed + k)
        step = U64(pow(base, size, 1 << 64))
        block = block[: len(block) - size] * step + block[size:]
        size *= 2


def within(doc: np.ndarray, k: int) -> np.ndarray:
    """Which windows of `k` words stay within one document."""
    return doc[: len(doc) - k + 1] == doc[k - 1 :] if len(doc) >= k else np.zeros(0, bool)


def shingles(words: Words, hashes: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """`first, hash`: the shingles of all documents and each document's first one.

    A document with fewer than `k` words has its whole sequence as one
    shingle; without words it has none.
    """
    counts = words.counts()
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(first[-1], U64)
    doc = words.doc()
    full = within(doc, k)
    long = np.repeat(counts >= k, n)
    out[long] = windows(hashes, k)[full]
    for size in range(1, k):
        which = np.flatnonzero(counts == size)
        if len(which):
            out[first[which]] = windows(hashes, size)[words.first[which]]
    return first, out


def map_slices(
    function: Callable[[pa.RecordBatch], pa.RecordBatch],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for `mapInArrow` that turns each slice into one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield function(part)

    return run
