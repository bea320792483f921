"""The BPE codec against the tokenizers library, its lexicon against a dictionary."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.conftest import SF_DIR
from tripleweft.llm import bpe
from tripleweft.llm.word_lexicon import Lexicon, compile_lexicon

ODD = [
    None, "", " \t\n\v\f\r ", "Hello  wörld's ΑΣ 'Sx<|endoftext|> 123 don't x <|ENDOFTEXT|>", "<|startoftext|><|endoftext|>x<|endoftext|",
    "é e ́x ̈ İIı ſ ﬀ ǅ", "a b c　d\x85e\x1cf\x00g​h", "日本語テキスト 한국어 ١٢٣ ½ Ⅷ x²", "👩‍👩‍👧 🇩🇪 \U0001f9ff",
    "we'll I'M they'RE ''s'' it's''t", "_a_b-c...!!!??? ###", "x" * 5000, "ab" * 3000 + " " + "!?" * 3000, "\U00031350ࡰ\U0001e4d0 ￿",
    "A" * 70 + " " + "A" * 64 + " " + "A" * 65, "1234567890 0", "﻿bom ️ x‍",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.VOCABULARY)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return len(ids), *(hashlib.sha256(t.encode()).hexdigest() for t in (" ".join(map(str, ids)), decoded))


def table(spark, texts):
    rows = [(k, t, 7) for k, t in enumerate(texts)] + [(None, "null id", 7), (3, texts[3], 7)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids int").repartition(4)


@pytest.mark.parametrize("size", [0, 5, 1 << 16])
def test_odd_texts_with_lexicons_of_any_size(spark, library, size):
    draw = random.Random(5)
    points = [*range(0x250), *range(0x300, 0x370), *range(0x1F00, 0x2100), *range(0x1100, 0x1120), *range(0xAC00, 0xAC20)]
    texts = ODD + ["".join(chr(draw.choice(points)) for _ in range(draw.randrange(40))) for _ in range(300)]
    docs = table(spark, texts)
    got = bpe.bpe_report(docs, size=size).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = "null id" if r["doc_id"] is None else texts[r["doc_id"]]
        assert tuple(r)[1:] == expected(library, text), text


def test_given_texts(spark, library):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = bpe.bpe_report(docs).collect()
    assert len(got) == len(texts)
    assert all(tuple(r)[1:] == expected(library, texts[r["doc_id"]]) for r in got)


def test_ids_and_texts_round_trip(spark, library):
    docs = table(spark, ODD)
    encoded = bpe.encode_texts(docs, bpe.build_lexicon(docs, size=20))
    ids = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    assert all(ids[k] == library.encode(t or "", add_special_tokens=False).ids for k, t in enumerate(ODD))
    texts = {r["doc_id"]: r["text"] for r in bpe.decode_ids(encoded).collect()}
    assert all(texts[k] == library.decode(i, skip_special_tokens=False) for k, i in ids.items())
    strange = spark.createDataFrame([(1, [518, 10**6, -4, None]), (2, None), (3, [])], "doc_id int, ids array<int>")
    assert sorted(tuple(r) for r in bpe.decode_ids(strange).collect()) == [(1, "the</w>"), (2, ""), (3, "")]


def test_counts_and_lexicon_words(spark):
    docs = spark.createDataFrame([(1, "b a a"), (2, None), (3, "a\tb  c"), (4, "d" * 70)], "doc_id int, text string")
    counts = {bytes(r["word"]).decode(): r["n"] for r in bpe.word_counts(docs).collect()}
    assert counts == {"a": 3, "b": 2, "c": 1, "d" * 70: 1}
    assert bpe.bpe_report(docs.where("false")).count() == 0


def test_merges_of_long_words_end(library):
    vocabulary = bpe.vocabulary_of(bpe.VOCABULARY)
    draw = random.Random(2)
    word = "".join(draw.choice("abcdeinthr") for _ in range(100_000))
    assert vocabulary.encode_word(word) == library.encode(word, add_special_tokens=False).ids
    words = ["".join(draw.choice("abcdeinthrs'1") for _ in range(draw.randint(1, 90))) for _ in range(3000)]
    offsets, ids = vocabulary.encode_words(words)
    for word, a, b in zip(words, offsets[:-1], offsets[1:], strict=True):
        assert ids[a:b].tolist() == library.encode(word, add_special_tokens=False).ids


def test_lexicon_finds_its_words_only():
    draw = random.Random(1)
    words = {bytes(draw.choice(b"abc") for _ in range(draw.randint(1, 9))): [draw.randrange(99) for _ in range(draw.randint(0, 3))] for _ in range(2000)}
    lexicon = Lexicon(compile_lexicon({**words, b"": [1], b"x" * 65: [2]}))
    asked = [*words, *(bytes(draw.choice(b"abcd") for _ in range(draw.randint(0, 10))) for _ in range(2000)), b"x" * 65]
    offsets = np.cumsum([0, *map(len, asked)])
    for word, place in zip(asked, lexicon.places(np.frombuffer(b"".join(asked), np.uint8), offsets), strict=True):
        assert (place >= 0) == (word in words)
        if place >= 0:
            assert list(lexicon.ids[lexicon.offsets[place] : lexicon.offsets[place + 1]]) == words[word]
    assert len(lexicon.final) < len({w[:k] for w in words for k in range(10)}) / 2  # suffixes are shared
    assert Lexicon(compile_lexicon({})).places(np.frombuffer(b"ab", np.uint8), np.array([0, 2])).tolist() == [-1]
