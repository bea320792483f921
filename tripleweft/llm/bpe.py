"""BPE encoding and decoding by a lexicon of frequent words.

The blank-separated words of all texts are counted, and the frequent ones are
compiled with their ids into a minimal acyclic transducer (`word_lexicon`), a
file that Spark hands to every executor and that the tasks memory-map. A task
looks up the distinct words of a slice of texts together; words outside of the
lexicon are normalised, split and merged one by one, exactly as the vocabulary
says. No token spans a blank, so the ids of a text are those of its words.

The vocabulary is a file of a public tokenizer: lower case, pieces split by a
pattern, byte-level symbols, an end-of-word mark, ranked merges.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tripleweft.llm.arrays import Words, map_slices, slices
from tripleweft.llm.runtime import materialize, prepare
from tripleweft.llm.word_lexicon import MAX_BYTES, Lexicon, compile_lexicon

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
LEXICON_WORDS = 1 << 16  # frequent words that are compiled; others are merged, with the same ids
_STEPS = 64  # in which the logarithm of a word's count is taken
LONG_PIECE = 64  # symbols; longer pieces are merged one by one

# What a vocabulary file must prescribe to be read here.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_PRE_TOKENIZERS = ["Split", "ByteLevel"]

_BLANK = regex.compile(r"\s")
_NO_RANK = 1 << 40


class Vocabulary:
    """Ids, ranked merges and word splitting of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as lines:
            spec = json.load(lines)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]], [x["type"] for x in split]
        added = spec["added_tokens"]
        if kinds != (_NORMALIZERS, _PRE_TOKENIZERS) or model["type"] != "BPE" or spec["decoder"] is not None:
            raise ValueError(f"{path} prescribes other steps than this codec takes")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError(f"{path} has added tokens that look at their surroundings")
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.added = {t["content"]: t["id"] for t in added}
        marks = sorted(map(regex.escape, self.added), key=len, reverse=True)
        self._added = regex.compile("(" + "|".join(marks) + ")") if marks else None
        self._pattern = regex.compile(f"(?:{split[0]['pattern']['Regex']})|\n")
        # code points beyond ASCII are normalised and classed by the library's own tables
        library = Tokenizer.from_file(path)
        self._normalise, self._split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        size = 1 + max([*self.ids.values(), *self.added.values()])
        self.tokens: list[bytes | None] = [None] * size
        for token, number in {**self.ids, **self.added}.items():
            self.tokens[number] = token.encode()
        self._keys = np.array(sorted(a << 32 | b for a, b in self.merges), np.int64)
        merged = [self.merges[k >> 32, k & 0xFFFFFFFF] for k in self._keys.tolist()]
        self._ranks, self._products = (np.array([m[i] for m in merged], np.int64) for i in (0, 1))
        self._symbol = np.zeros((2, 1 << 16), np.int64)  # of a character inside of and at the end of a piece
        for token, number in self.ids.items():
            for at_end, suffix in enumerate(("", self.suffix)):
                if token.endswith(suffix) and len(token) == 1 + len(suffix):
                    self._symbol[at_end, ord(token[0])] = number

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """`offsets, ids` of texts without blanks.

        The words are normalised and split together, as lines of one text, and
        their distinct pieces are merged together. Those with a blank beyond
        ASCII or an added token are taken one by one.
        """
        odd = [bool(_BLANK.search(w) or (self._added and self._added.search(w))) for w in words]
        plain = [w.isascii() and w.isprintable() for w in words]
        ascii_only = [k for k, w in enumerate(words) if plain[k] and not odd[k]]
        wider = [k for k, w in enumerate(words) if not plain[k] and not odd[k]]
        numbers: dict[str, int] = {"\n": 0}

        def numbered(pieces: list[str]) -> np.ndarray:
            return np.array([numbers.setdefault(piece, len(numbers)) for piece in pieces], np.int64)

        codes = numbered(self._pattern.findall("\n".join([words[k] for k in ascii_only]).lower()))
        owners = np.cumsum(codes == 0)[codes != 0]
        lines = self._normalise("\n".join([words[k] for k in wider]))  # line ends become spaces
        found = self._split(lines) if wider else []
        spaces = np.flatnonzero(np.frombuffer(lines.encode("utf-32-le"), np.uint32) == ord(" "))
        owners_wider = np.searchsorted(spaces, np.array([span[0] for _, span in found], np.int64))
        codes = np.concatenate([codes[codes != 0], numbered([piece for piece, _ in found])])
        owners = np.concatenate([np.array(part, np.int64)[of] for part, of in ((ascii_only, owners), (wider, owners_wider))])
        one_by_one = [k for k, own in enumerate(odd) if own]
        alone = [self.encode_word(words[k]) for k in one_by_one]

        starts, lengths, pool = self._merge_all(list(numbers)[1:])
        run, runs = starts[codes - 1], lengths[codes - 1]
        n_ids = np.bincount(owners, weights=runs, minlength=len(words)).astype(np.int64)
        n_ids[one_by_one] = [len(ids) for ids in alone]
        offsets = np.concatenate([[0], np.cumsum(n_ids)])
        out = np.zeros(offsets[-1], np.int32)
        within = np.cumsum(runs) - runs  # where a piece's ids go: after those of its word's earlier pieces
        first = np.flatnonzero(np.diff(owners, prepend=-1))
        within -= np.repeat(within[first], np.diff(np.append(first, len(owners))))
        out[_spread(offsets[owners] + within, runs)] = pool[_spread(run, runs)]
        for k, ids in zip(one_by_one, alone, strict=True):
            out[offsets[k] : offsets[k + 1]] = ids
        return offsets, out

    def encode_word(self, word: str) -> list[int]:
        """The ids of one text without blanks."""
        parts = self._added.split(word) if self._added else [word]
        out: list[int] = []
        for part in parts:
            if part in self.added:
                out.append(self.added[part])
            elif part:
                starts, lengths, pool = self._merge_all([piece for piece, _ in self._split(self._normalise(part))])
                out += pool[_spread(starts, lengths)].tolist()
        return out

    def _merge_all(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """`starts, lengths, ids`: every piece's ids stand in `ids` from its start on.

        In each round every piece merges its pair of lowest rank, the leftmost
        of equals; pieces without a pair leave. Long pieces, whose rounds would
        be many, take a heap.
        """
        size = np.array([len(p) for p in pieces], np.int64)
        starts, lengths = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        done: list[np.ndarray] = []
        n_done = 0

        def finish(which: np.ndarray, of: np.ndarray, ids: np.ndarray) -> None:
            nonlocal n_done
            starts[which], lengths[which] = n_done + np.cumsum(of) - of, of
            done.append(ids)
            n_done += len(ids)

        for k in np.flatnonzero(size > LONG_PIECE).tolist():
            ids = np.array(self._merge_one(pieces[k]), np.int64)
            finish(np.array([k]), np.array([len(ids)]), ids)
        which = np.flatnonzero(size <= LONG_PIECE)
        text = "".join([pieces[k] for k in which.tolist()]).encode("utf-32-le")
        length = size[which]
        at_end = np.zeros(length.sum(), np.int64)
        at_end[np.cumsum(length) - 1] = 1
        symbol = self._symbol[at_end, np.frombuffer(text, np.uint32)]
        rank, product = self._pairs(symbol[:-1], symbol[1:])
        rank, product = np.append(rank, _NO_RANK), np.append(product, 0)
        rank[np.cumsum(length) - 1] = _NO_RANK
        while len(which):
            first = np.cumsum(length) - length
            least = np.minimum.reduceat(rank, first)
            live = least < _NO_RANK
            if not live.all():
                kept = np.repeat(live, length)
                finish(which[~live], length[~live], symbol[~kept])
                which, length, least = which[live], length[live], least[live]
                symbol, rank, product = symbol[kept], rank[kept], product[kept]
                if not len(which):
                    break
            piece = np.repeat(np.arange(len(which)), length)
            at = np.flatnonzero(rank == least[piece])
            at = at[np.diff(piece[at], prepend=-1) != 0]  # the leftmost of each piece
            symbol[at] = product[at]
            kept = np.ones(len(symbol), bool)
            kept[at + 1] = False
            symbol, rank, product, piece = symbol[kept], rank[kept], product[kept], piece[kept]
            at -= np.arange(len(at))
            length = length - 1
            changed = np.concatenate([at, at[at > 0] - 1])
            after = np.minimum(changed + 1, len(symbol) - 1)
            rank[changed], product[changed] = self._pairs(symbol[changed], symbol[after])
            rank[changed[(piece[changed] != piece[after]) | (after == changed)]] = _NO_RANK
        return starts, lengths, np.concatenate([*done, np.zeros(0, np.int64)]).astype(np.int32)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and products of pairs of symbols."""
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self._keys, wanted), len(self._keys) - 1)
        return np.where(self._keys[at] == wanted, self._ranks[at], _NO_RANK), self._products[at]

    def _merge_one(self, piece: str) -> list[int]:
        """The same for one piece by a heap of its pairs."""
        symbols = [self.ids[c] for c in piece[:-1]] + [self.ids[piece[-1] + self.suffix]]
        after = [*range(1, len(symbols)), -1]
        before = list(range(-1, len(symbols) - 1))
        waiting: list[tuple[int, int, int, int, int]] = []

        def consider(left: int, right: int) -> None:
            if left >= 0 and right >= 0 and (found := self.merges.get((symbols[left], symbols[right]))):
                heapq.heappush(waiting, (found[0], left, symbols[left], symbols[right], found[1]))

        for left in range(len(symbols) - 1):
            consider(left, left + 1)
        while waiting:
            _, left, a, b, merged = heapq.heappop(waiting)
            right = after[left]
            if symbols[left] != a or right < 0 or symbols[right] != b:
                continue  # one of the two has been merged with another neighbour
            symbols[left], symbols[right], after[left] = merged, -1, after[right]
            if after[left] >= 0:
                before[after[left]] = left
            consider(before[left], left)
            consider(left, after[left])
        return [s for s in symbols if s >= 0]

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens joined by one space, in UTF-8; ids that the vocabulary lacks are passed over."""
        tokens = self.tokens
        try:
            return b" ".join([tokens[i] for i in ids.tolist()])
        except (TypeError, IndexError):
            known = [tokens[i] for i in ids.tolist() if 0 <= i < len(tokens)]
            return b" ".join(t for t in known if t is not None)


@cache
def vocabulary_of(path: str) -> Vocabulary:
    """A vocabulary, read once per worker."""
    return Vocabulary(path)


@cache
def _lexicon(name: str) -> Lexicon:
    """The lexicon file that Spark brought to this machine, memory-mapped."""
    return Lexicon(np.load(SparkFiles.get(name), mmap_mode="r"))


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all ragged runs, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _encode(texts: pa.Array, vocabulary: Vocabulary, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """`offsets, ids` of the texts of a slice."""
    words = Words(texts)
    numbered = words.numbered()
    distinct, code = numbered.dictionary, numbered.indices.to_numpy()
    offsets = np.frombuffer(distinct.buffers()[1], np.int64)[: len(distinct) + 1] if len(distinct) else np.zeros(1, np.int64)
    data = np.frombuffer(distinct.buffers()[2] or b"", np.uint8)
    place = lexicon.places(data, offsets)
    missing = np.flatnonzero(place < 0)
    unseen, merged = vocabulary.encode_words([data[offsets[k] : offsets[k + 1]].tobytes().decode() for k in missing.tolist()])
    length = np.diff(lexicon.offsets).astype(np.int64)[place] if lexicon.n_words else np.zeros(len(place), np.int64)
    start = lexicon.offsets[place].astype(np.int64)
    length[missing] = np.diff(unseen)
    start[missing] = len(lexicon.ids) + unseen[:-1]
    pool = np.concatenate([lexicon.ids, merged])
    per_word = length[code]
    ids = pool[_spread(start[code], per_word)]
    return np.concatenate([[0], np.cumsum(per_word)])[words.first], ids


def word_counts(docs: DataFrame) -> DataFrame:
    """`word` (UTF-8 bytes), `n`: how often each blank-separated word occurs in all texts.

    Null and empty texts have none.
    """
    prepare(docs.sparkSession)

    def count(part: pa.RecordBatch) -> pa.RecordBatch:
        numbered = Words(part.column("text")).numbered()
        n = np.bincount(numbered.indices.to_numpy(), minlength=len(numbered.dictionary))
        return pa.record_batch([numbered.dictionary.cast(pa.binary()), pa.array(n, pa.int64())], ["word", "n"])

    counted = docs.select("text").mapInArrow(map_slices(count), "word binary, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, vocabulary: str = VOCABULARY, size: int = LEXICON_WORDS) -> str:
    """Compile the most frequent words of all texts, at most `size`; returns the name of the file for the tasks.

    Words of about one count, a step of 1.1 %, come in together or not at all.
    Words over 64 bytes and those that occur once stay outside. Only the words
    that are compiled come to the driver. Without texts the lexicon is empty
    and every word is merged.
    """
    spark = prepare(docs.sparkSession)
    counted = word_counts(docs).where((F.octet_length("word") <= MAX_BYTES) & (F.col("n") > 1))
    counted = materialize(counted.withColumn("step", F.floor(F.log2("n") * F.lit(_STEPS)).cast("int")), "word-counts")
    # counts fall into at most 64 * 63 steps; the least step whose words and all above fit in
    steps = counted.groupBy("step").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("step")).collect()
    least, total = None, 0
    for row in steps:
        total += row["words"]
        if total > size:
            break
        least = row["step"]
    frequent = [] if least is None else [bytes(r["word"]) for r in counted.where(F.col("step") >= least).select("word").collect()]
    offsets, ids = vocabulary_of(vocabulary).encode_words([w.decode() for w in frequent])
    ids_of = {w: ids[a:b].tolist() for w, a, b in zip(frequent, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)}
    name = f"lexicon-{uuid.uuid4().hex}.npy"
    path = Path(tempfile.mkdtemp(prefix="lexicon-")) / name
    np.save(path, compile_lexicon(ids_of))
    spark.sparkContext.addFile(str(path))
    return name


def encode_texts(docs: DataFrame, lexicon: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """`doc_id, ids` of every row; null, empty and blank texts have no ids, repeated rows stay.

    The strings of added tokens in a text become their ids. `vocabulary` must
    be readable under one path on all workers; `lexicon` comes from
    `build_lexicon`, from these texts or others: it never changes the ids.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, words = vocabulary_of(vocabulary), _lexicon(lexicon)
        for part in slices(batches):
            offsets, ids = _encode(part.column("text"), codec, words)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.record_batch([part.column("doc_id"), lists], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_ids(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """`doc_id, text` from `doc_id, ids`: the tokens joined by a space, end-of-word marks included.

    Null and empty lists give an empty text; ids that the vocabulary lacks, and
    nulls, are passed over.
    """
    prepare(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = vocabulary_of(vocabulary)
        for batch in batches:
            texts = [codec.decode(np.array([i for i in ids or [] if i is not None], np.int64)).decode() for ids in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def bpe_report(docs: DataFrame, vocabulary: str = VOCABULARY, size: int = LEXICON_WORDS) -> DataFrame:
    """`doc_id, n_tokens, ids_sha256, decoded_sha256` of every row, encoded by a lexicon of its texts and decoded.

    Ids are hashed as decimals joined by a space. Null, empty and blank texts
    have no tokens and the hashes of an empty text; repeated rows give repeated
    rows; an empty table gives no rows; other columns are not read.
    """
    lexicon = build_lexicon(docs, vocabulary, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, words = vocabulary_of(vocabulary), _lexicon(lexicon)
        decimal = [str(i).encode() for i in range(len(codec.tokens))]
        for part in slices(batches):
            offsets, ids = _encode(part.column("text"), codec, words)
            bounds = list(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
            written = [hashlib.sha256(b" ".join([decimal[i] for i in ids[a:b].tolist()])).hexdigest() for a, b in bounds]
            read = [hashlib.sha256(codec.decode(ids[a:b])).hexdigest() for a, b in bounds]
            columns = [part.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(written), pa.array(read)]
            yield pa.record_batch(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
