"""Byte-level BPE beside the tokenizer itself."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from loomtext.llm import byte_bpe
from loomtext.llm.byte_bpe import EVERY, Encoder, decode_byte_bpe, encode_byte_bpe, read_ranks

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = read_ranks(PATH)
TOKENIZER = tiktoken.Encoding(
    "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={}
)
HARD = [
    "", " ", "\n\n  x", "a  b", "it's we'll I'd", "x" * 63 + " " + "y" * 64 + " " + "z" * 65, "é" * 300,
    "中文" * 500, "a" * 5000, "ab" * 900 + "abc" * 300, "!?" * 700, " " * 999 + "x", "ACGT" * 200 + "TTAGGG" * 90,
    "<|endoftext|> stays text", "12345 6789 \x1c\x85\xa0 x", "👩‍👩‍👧 é", "\x00\x01",
]


@pytest.fixture(scope="module")
def encoder():
    return Encoder(RANKS, public_tokenizers.PATTERN)


def ids(found):
    return np.frombuffer(found, np.int32).tolist()


def test_texts_equal_the_tokenizer(encoder, monkeypatch):
    rng = random.Random(2)
    texts = HARD + ["".join(rng.choice("abé ☃\n'1.") for _ in range(rng.randrange(300))) for _ in range(60)]
    expected = [TOKENIZER.encode_ordinary(t) for t in texts]
    assert [ids(e) for e in encoder.encode(texts)] == expected
    # The same when every limit is met: cuts of long texts, rows of a query, kept words.
    for name, value in (("CUT_AT_ONCE", 10), ("CUT_WORDS", 3), ("QUERY_ROWS", 40), ("CACHED_WORDS", 20)):
        monkeypatch.setattr(byte_bpe, name, value)
    encoder.known, encoder.older = {}, {}
    assert [ids(e) for e in encoder.encode(texts)] == expected


def test_characters_of_all_kinds_are_cut_alike(encoder):
    points = [c for c in range(1, 0x30000, 23) if not 0xD800 <= c < 0xE000]
    points += [*range(0x2000, 0x2070), *range(0x80, 0x100), 0x85, 0x1680, 0x180E, 0x3000, 0xFEFF]
    texts = [f"x{chr(c)}y 1{chr(c)}2 {chr(c)}{chr(c)}\n{chr(c)} " for c in points]
    assert [ids(e) for e in encoder.encode(texts)] == [TOKENIZER.encode_ordinary(t) for t in texts]


def test_both_kinds_of_rounds_agree(encoder):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 60))).encode() for _ in range(400)]
    assert encoder.contracted(words, EVERY) == encoder.contracted(words)


def test_ranks_that_fall_are_contracted_singly():
    """A vocabulary whose merges do not rise: joining a pair makes one of a smaller rank."""
    letters = {bytes([b]): 1000 + b for b in range(256)}
    ranks = letters | {b"ab": 50, b"abab": 3, b"aba": 2, b"bab": 60, b"abb": 1, b"ba": 55}
    own = Encoder(ranks, r"\S+")
    rng = random.Random(9)
    words = ["".join(rng.choice("ab") for _ in range(n)) for n in range(1, 120)]

    def plainly(word):
        if word.encode() in ranks:
            return [ranks[word.encode()]]
        parts = [bytes([b]) for b in word.encode()]
        while True:
            pairs = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not pairs:
                return [ranks[p] for p in parts]
            _, k = min(pairs)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    assert [ids(e) for e in own.encode(words)] == [plainly(w) for w in words]


def test_tables(spark):
    rows = [(i, t, 7, 8) for i, t in enumerate([*HARD, None, HARD[3], HARD[3], "word " * 200_000])]
    docs = spark.createDataFrame(rows + [(None, "no id", 7, 8)], "doc_id long, text string, ids long, decoded long")
    encoded = encode_byte_bpe(docs, PATH, public_tokenizers.PATTERN, keep=["doc_id", "text", "ids"])
    assert encoded.columns == ["doc_id", "text", "ids"]
    found = encoded.collect()
    assert len(found) == len(rows) + 1
    for r in found:
        assert r.ids == TOKENIZER.encode_ordinary(r.text or "")
    back = decode_byte_bpe(encoded, PATH, keep=["text"]).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back)
    odd = spark.createDataFrame([(1, None), (2, []), (3, [64, 10**6, None, 65])], "k long, ids array<int>")
    spelled = {v: k for k, v in RANKS.items()}
    assert {r.k: bytes(r.decoded) for r in decode_byte_bpe(odd, PATH, keep=["k"]).collect()} == {
        1: b"", 2: b"", 3: spelled[64] + spelled[65],
    }
    assert encode_byte_bpe(docs.where("false"), PATH, r"\S+", keep=["doc_id"]).collect() == []
