"""Byte-level BPE: ids against the library's, exact round trips, and merges against a plain loop."""

import random
import unicodedata
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from fixtures import awkward, clashing, empty, rows_of

from tallymark.llm import byte_bpe, queries
from tallymark.llm.byte_bpe import ByteBpe, PerfectHash, Splitter

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def bpe():
    return queries.byte_tokenizer()


@pytest.fixture(scope="module")
def library(bpe):
    ranks = {token: i for i, token in bpe.tokens.items()}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(seed: int) -> list:
    chance = random.Random(seed)
    wide = [chr(c) for c in range(0x3000)] + list(" \t\n\r'sdlvtrem  ") * 100 + ["\U0001f600", "\U00010400"] * 50
    texts = ["".join(chance.choices(wide, k=chance.randrange(60))) for _ in range(1500)]
    texts += ["".join(chance.choices([chr(c) for c in range(256)] + list(" \n'sdlvtrem") * 8, k=chance.randrange(60))) for _ in range(1500)]
    texts += ["a" * 7**n for n in range(6)] + ["ab" * 500, "é" * 5000, " " * 999, "\n \n", "x  y", "<|endoftext|>", None, ""]
    return texts


def test_ids_are_the_librarys(bpe, library, monkeypatch):
    texts = odd_texts(1)
    wanted = [library.encode_ordinary(t or "") for t in texts]
    assert [x.tolist() for x in Splitter(bpe).encode(texts)] == wanted
    monkeypatch.setattr(byte_bpe, "PIECE_CHARACTERS", 16)  # long texts piece by piece
    monkeypatch.setattr("tallymark.llm.resident.CACHE_BYTES", 3000)  # and what is known often forgotten
    splitter = Splitter(bpe)
    assert [x.tolist() for x in splitter.encode(texts)] == wanted
    assert [bpe.decode(np.array(x, "<u4")).decode() for x in wanted] == [t or "" for t in texts]


def test_characters_of_all_classes(bpe, library):
    # both sides of every place where the category changes
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    ends = [pair for pair in zip(every, every[1:]) if unicodedata.category(pair[0]) != unicodedata.category(pair[1])]
    points = sorted({c for pair in ends for c in pair})
    texts = ["".join(f"a{c}1{c}! {c} a{c}{c} " for c in points[i : i + 4096]) for i in range(0, len(points), 4096)]
    assert [x.tolist() for x in Splitter(bpe).encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_both_tiers_are_used(bpe, monkeypatch):
    asked = []
    original = byte_bpe.merged
    monkeypatch.setattr(byte_bpe, "merged", lambda piece, *rest: asked.append(piece) or original(piece, *rest))
    assert len(bpe.encode_pieces([b" the", b"qzxjqzxj", b"a"])) == 3
    assert asked == [b"qzxjqzxj"]


def plain(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    parts = [bytes([b]) for b in piece]
    while True:
        known = [(ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in ranks]
        if not known:
            return [ranks[p] for p in parts]
        _, i = min(known)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("seed", range(4))
def test_merges_equal_a_plain_loop(seed):
    chance = random.Random(seed)
    tokens = [bytes([b]) for b in range(256)]
    while len(tokens) < 330:
        token = b"".join(chance.choices([t for t in tokens if t[0] in b"abc"], k=2))
        if token not in tokens:
            tokens.append(token)
    ranks = {t: 5 * i + 3 for i, t in enumerate(tokens)}
    bpe = ByteBpe(ranks, r"\S+|\s+")
    for _ in range(400):
        piece = bytes(chance.choices(b"abcd", k=chance.randrange(1, 40)))
        assert byte_bpe.merged(piece, bpe.single, bpe.pairs) == plain(piece, ranks)


@pytest.mark.parametrize("count", [0, 1, 2, 3, 10, 5000])
def test_perfect_hash(count):
    keys = [f"key {i * i}".encode() * (i % 5 + 1) for i in range(count)]
    numbers = PerfectHash(keys)
    assert numbers.look_up(keys).tolist() == list(range(count))
    assert len(numbers.keys) == count  # no slot left over
    others = [b"", b"key", b"x" * 500, *(k + b"\0" for k in keys)]
    assert (numbers.look_up(others) == -1).all()


def test_refusals(bpe):
    with pytest.raises(ValueError):
        PerfectHash([b"a", b"a"])
    with pytest.raises(ValueError):
        ByteBpe({b"a": 0}, ".")
    with pytest.raises(KeyError):
        bpe.decode(np.array([10**6], "<u4"))


@pytest.mark.parametrize("make", [awkward, empty, lambda s: clashing(awkward(s)), lambda s: queries.table(s, FOLDER, "documents")])
def test_query_equals_library(spark, make, library, tmp_path):
    docs = make(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    expected = []
    for r in docs.collect():
        ids = library.encode_ordinary(r.text or "")
        digest = sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        expected.append((r.doc_id, len(ids), digest, sha256((r.text or "").encode()).hexdigest()))
    assert rows_of(queries.op12_byte_bpe(spark, str(tmp_path))) == sorted(expected, key=repr)


def test_null_ids_decode_to_null(spark, bpe):
    rows = spark.createDataFrame([(1, None), (2, bytearray())], "n int, ids binary")
    assert rows_of(byte_bpe.decode(rows, bpe)) == [(1, None, None), (2, bytearray(), bytearray())]
