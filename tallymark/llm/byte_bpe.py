"""Byte-level BPE, encoding and decoding, with a table of ranks.

A pattern splits a text in pre-tokens. The distinct ones of a batch are looked up in two tiers. A
minimal perfect hash over the vocabulary resolves those that are tokens as a whole: as many slots
as tokens, found by a displacement per bucket of keys, and one comparison of bytes, for
many at a time. What it misses is merged from its bytes: they are linked, a heap holds the ranks of
neighbours that form a token, and the lowest rank, of equal ones the leftmost, is merged next.
"""

from __future__ import annotations

import base64
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator, Sequence
from heapq import heapify, heappop, heappush
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tallymark.llm.resident import Places, resident

#: Characters whose pre-tokens are listed at once.
PIECE_CHARACTERS = 1 << 20
#: Keys a bucket of the hash, on average.
PER_BUCKET = 3
STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Numbers distinct byte strings from 0, each in a slot of its own and no slot left over."""

    def __init__(self, keys: Sequence[bytes]):
        self.count = len(keys)
        self.width = -(-max(map(len, keys), default=1) // 8) * 8
        lengths = np.array([len(k) for k in keys], np.int64)
        padded = self._padded(keys, lengths)
        hashes = self._hashes(padded, lengths)
        if len(np.unique(hashes)) < self.count:
            raise ValueError("keys are not distinct")
        self.buckets = np.uint64(max(1, self.count // PER_BUCKET))
        self.shift = np.zeros(int(self.buckets), np.int64)
        slots = np.zeros(self.count, np.int64)
        taken = np.zeros(self.count, bool)
        order = np.argsort(hashes % self.buckets, kind="stable")
        heads, starts = np.unique((hashes % self.buckets)[order], return_index=True)
        groups = sorted(zip(heads.tolist(), np.split(order, starts[1:])), key=lambda g: -len(g[1]))  # noqa: B905
        free: Iterator[int] | None = None
        for bucket, own in groups if self.count else ():
            if len(own) == 1:  # the last ones: a slot each, named outright
                free = free or iter(np.flatnonzero(~taken).tolist())
                slots[own[0]] = next(free)
                self.shift[bucket] = -1 - slots[own[0]]
                continue
            first = 0
            while True:
                tries = np.arange(first, first + 64, dtype=np.uint64)
                found = (mixed(hashes[own][None] + tries[:, None] * STEP) % np.uint64(self.count)).astype(np.int64)
                ordered = np.sort(found, axis=1)
                good = np.flatnonzero(~taken[found].any(1) & (ordered[:, 1:] != ordered[:, :-1]).all(1))
                if len(good):
                    break
                first += 64
            self.shift[bucket], slots[own] = first + good[0], found[good[0]]
            taken[slots[own]] = True
        self.numbers = np.zeros(self.count, np.int64)
        self.numbers[slots] = np.arange(self.count)
        self.keys, self.lengths = np.zeros_like(padded), np.zeros_like(lengths)
        self.keys[slots], self.lengths[slots] = padded, lengths

    def _padded(self, keys: Sequence[bytes], lengths: np.ndarray) -> np.ndarray:
        out = np.zeros((len(keys), self.width), np.uint8)
        starts = np.cumsum(lengths) - lengths
        column = np.arange(int(lengths.sum())) - np.repeat(starts, lengths)
        out[np.repeat(np.arange(len(keys)), lengths), column] = np.frombuffer(b"".join(keys), np.uint8)
        return out

    def _hashes(self, padded: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        total = mixed(lengths.astype(np.uint64))
        for i in range(self.width // 8):
            total = mixed(total * STEP + padded[:, 8 * i : 8 * i + 8].copy().view("<u8")[:, 0])
        return total

    def look_up(self, keys: Sequence[bytes]) -> np.ndarray:
        """The number of each string, -1 for one that is no key."""
        out = np.full(len(keys), -1, np.int64)
        lengths = np.fromiter(map(len, keys), np.int64, len(keys))
        some = np.flatnonzero((lengths > 0) & (lengths <= self.width))
        if not len(some) or not self.count:
            return out
        own = lengths[some]
        padded = self._padded([keys[i] for i in some], own)
        hashes = self._hashes(padded, own)
        shift = self.shift[hashes % self.buckets]
        moved = mixed(hashes + np.maximum(shift, 0).astype(np.uint64) * STEP) % np.uint64(self.count)
        slots = np.where(shift < 0, -1 - shift, moved.astype(np.int64))
        same = (self.lengths[slots] == own) & (self.keys[slots] == padded).all(1)
        out[some[same]] = self.numbers[slots[same]]
        return out


def merged(piece: bytes, single: Sequence[int], pairs: dict[int, int]) -> list[int]:
    """The ids of a pre-token: neighbours are merged, lowest id first and from the left, while any two form a token."""
    ids = [single[b] for b in piece]
    n = len(ids)
    after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
    heap = [both << 32 | i for i in range(n - 1) if (both := pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
    heapify(heap)
    while heap:
        top = heappop(heap)
        both, i = top >> 32, top & 0xFFFFFFFF
        j = after[i]
        if ids[i] < 0 or j >= n or pairs.get(ids[i] << 32 | ids[j]) != both:
            continue  # one of the two has been merged since
        k = after[i] = after[j]
        ids[i], ids[j] = both, -1
        if k < n:
            before[k] = i
            if (more := pairs.get(both << 32 | ids[k])) is not None:
                heappush(heap, more << 32 | i)
        h = before[i]
        if h >= 0 and (more := pairs.get(ids[h] << 32 | both)) is not None:
            heappush(heap, more << 32 | h)
    return [x for x in ids if x >= 0]


def narrow(pattern: str) -> re.Pattern | None:
    """The same pattern with classes written out, for texts below U+0100 only, which the plain module splits sooner."""
    points = [chr(c) for c in range(256)]
    letters = "".join(re.escape(c) for c in points if unicodedata.category(c)[0] == "L")
    numbers = "".join(re.escape(c) for c in points if unicodedata.category(c)[0] == "N")
    space = "\\t\\n\\x0b\\x0c\\r\\x20\\x85\\xa0"
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letters}{numbers}]")
    for name, inside in ((r"\p{L}", letters), (r"\p{N}", numbers), (r"\s", space), (r"\S", "^" + space)):
        plain = plain.replace(name, f"[{inside}]")
    return None if r"\p" in plain or "(?i" in plain else re.compile(plain)


class ByteBpe:
    """A vocabulary of byte strings with ranks, which are the ids, and a pattern of pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"no id for bytes {missing}")
        tokens = sorted(ranks, key=ranks.__getitem__)
        self.pattern = pattern
        self.ids = np.array([ranks[t] for t in tokens], np.int64)
        self.tokens = dict(zip(self.ids.tolist(), tokens, strict=True))
        self.hash = PerfectHash(tokens)
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.pairs = {
            ranks[t[:i]] << 32 | ranks[t[i:]]: ranks[t] for t in tokens for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks
        }
        self.name = (pattern, zlib.crc32(b"\n".join(tokens)), zlib.crc32(self.ids.tobytes()))

    @staticmethod
    def from_file(path: str, pattern: str) -> "ByteBpe":
        """A file of lines with a token in base 64 and its rank."""
        with open(path, "rb") as file:
            lines = [line.split() for line in file if line.strip()]
        return ByteBpe({base64.b64decode(token): int(rank) for token, rank in lines}, pattern)

    def encode_pieces(self, pieces: Sequence[bytes]) -> list[Sequence[int]]:
        """The ids of each pre-token: whole ones by the perfect hash, the rest by merges."""
        found = self.hash.look_up(pieces)
        whole = self.ids[found].tolist()
        return [
            (i,) if known else merged(p, self.single, self.pairs)
            for p, known, i in zip(pieces, (found >= 0).tolist(), whole, strict=True)
        ]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids in a row; an id that is no token's raises KeyError."""
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


class Splitter:
    """Splits texts and keeps the ids of the pre-tokens met, in one worker process, up to a bound in bytes."""

    def __init__(self, bpe: ByteBpe):
        self.bpe = bpe
        self.wide, self.narrow = regex.compile(bpe.pattern), narrow(bpe.pattern)
        self._start_anew()

    def _start_anew(self) -> None:
        self.places = Places()
        self.starts, self.flat = array("q", [0]), array("I")  # ids of place p: flat[starts[p] : starts[p + 1]]

    def _pieces(self, text: str) -> Iterator[list[str]]:
        pattern = self.wide
        if self.narrow and (text.isascii() or max(text) < "Ā"):
            pattern = self.narrow
        if len(text) <= PIECE_CHARACTERS:
            yield pattern.findall(text)
            return
        found = pattern.finditer(text)
        while some := [m.group() for m in islice(found, PIECE_CHARACTERS // 8)]:
            yield some

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens in a row, and how many each has."""
        if self.places.full:
            self._start_anew()
        found = np.fromiter(map(self.places.__getitem__, pieces), np.int64, len(pieces))
        new = self.places.new
        for own in self.bpe.encode_pieces([p.encode() for p in new]) if new else ():
            self.flat.extend(own)
            self.starts.append(len(self.flat))
        new.clear()
        starts = np.frombuffer(self.starts, np.int64)
        lengths = starts[found + 1] - starts[found]
        ends = np.cumsum(lengths)
        take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[found] - (ends - lengths), lengths)
        flat = np.frombuffer(self.flat, np.uint32)[take] if len(take) else np.zeros(0, np.uint32)
        return flat, lengths

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """One array of ids a text; a null text has none."""
        out: list[np.ndarray] = []
        some: list[list[str]] = []
        size = 0
        for text in texts:
            if len(text or "") > PIECE_CHARACTERS:
                out += self._together(some)
                out.append(np.concatenate([self._ids(p)[0] for p in self._pieces(text)]))
                some, size = [], 0
                continue
            some.append(next(self._pieces(text)) if text else [])
            size += len(text or "")
            if size > PIECE_CHARACTERS:
                out += self._together(some)
                some, size = [], 0
        return out + self._together(some)

    def _together(self, some: list[list[str]]) -> list[np.ndarray]:
        if not some:
            return []
        ids, lengths = self._ids(list(chain.from_iterable(some)))
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum([len(p) for p in some])]
        return np.split(ids, ends[:-1])


def encode(docs: DataFrame, bpe: ByteBpe, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: its id and ids, those of its whole text as little-endian unsigned 32-bit numbers, without special tokens.

    A null text is empty and has no ids. Repeated rows and null ids are kept; other columns are
    ignored whatever their names; empty input gives no rows. Texts of any length are split
    piece by piece; a single pre-token takes some 100 bytes of memory for each of its own.
    """
    bare = docs.select(F.col(id_column).alias(id_column), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(bpe)  # the size of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = resident(("byte bpe", shared.value.name), lambda: Splitter(shared.value))
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                some = batch.slice(start, 500)
                ids = [x.astype("<u4").tobytes() for x in splitter.encode(some.column("text").to_pylist())]
                yield pa.record_batch([some.column(id_column), pa.array(ids, pa.binary())], names=[id_column, "ids"])

    return bare.mapInArrow(run, f"{id_column} {dict(bare.dtypes)[id_column]}, ids binary")


def decode(rows: DataFrame, bpe: ByteBpe, ids: str = "ids") -> DataFrame:
    """The rows with ``decoded``, the bytes that their ids stand for; null ids give null.

    The bytes are those of the text that was encoded; any other ids may give bytes that are no text.
    """
    shared = rows.sparkSession.sparkContext.broadcast(bpe)
    at = rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                some = batch.slice(start, 500)
                raw = (None if x is None else shared.value.decode(np.frombuffer(x, "<u4")) for x in some.column(at).to_pylist())
                yield pa.record_batch([*some.columns, pa.array(list(raw), pa.binary())], names=[*some.schema.names, "decoded"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("decoded", BinaryType())]))
