"""Token ids of whole texts with a public tokenizer, fast enough to be the main path.

Encoding a text as a whole costs most of its time on words met many times before. The
tokenizers handled here drop white space and never look across it, so the ids of a text are
those of its space-separated chunks in a row; each distinct chunk goes to the library once per
cache generation, which is bounded in bytes. ``drops_spaces`` checks that property from the tokenizer file; files that do
not have it are encoded whole. A chunk's word of plain letters is one pre-token that the library's normaliser leaves as it
is, so it goes straight to the library's model, where ``plain_letters`` finds in the file that this is so.
"""

from __future__ import annotations

import hashlib
import json
import os
import string
import unicodedata
from array import array
from collections.abc import Sequence
from itertools import chain

import numpy as np

from tallymark.llm.resident import Places, resident


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def file_digest(path: str) -> str:
    """Names the tokenizer's version: the digest of its file."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def drops_spaces(path: str) -> bool:
    """Whether ids of a text are those of its space-separated chunks in a row.

    True when every run of white space becomes one space and the first split keeps only matches
    of a pattern whose every branch excludes white space.
    """
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    normalizer = spec.get("normalizer") or {}
    steps = normalizer.get("normalizers", [normalizer] if normalizer else [])
    if any(step["type"] not in ("NFC", "NFD", "Lowercase", "Replace") for step in steps):
        return False
    if any(s["type"] == "Replace" and (s["pattern"], s["content"]) != ({"Regex": "\\s+"}, " ") for s in steps):
        return False
    splitter = spec.get("pre_tokenizer") or {}
    first = (splitter.get("pretokenizers") or [splitter])[0]
    if first.get("type") != "Split" or first.get("behavior") != "Removed" or not first.get("invert"):
        return False
    if any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        return False
    branches = first["pattern"].get("Regex", " ").split("|")
    spaceless = ("[\\p{L}]+", "[\\p{N}]", "[^\\s\\p{L}\\p{N}]+")
    return all(b in spaceless or (b[:1] == "'" and b[1:].isalpha()) for b in branches)


def plain_letters(path: str) -> frozenset[str]:
    """Lower-case letters whose words a chunked tokenizer's model takes as they are, but for bytes as characters.

    None unless words of letters are one pre-token, the model is BPE over bytes without dropout,
    texts are normalised to NFC at most, and no added token can lie within a word.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    normalizer = spec.get("normalizer") or {}
    steps = normalizer.get("normalizers", [normalizer] if normalizer else [])
    splitters = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    if any(step["type"] == "NFD" for step in steps) or [p["type"] for p in splitters] != ["Split", "ByteLevel"]:
        return frozenset()
    bytewise, model = splitters[1], spec["model"]
    if bytewise.get("add_prefix_space") or bytewise.get("use_regex", True) or "[\\p{L}]+" not in splitters[0]["pattern"]["Regex"].split("|"):
        return frozenset()
    if model.get("type") != "BPE" or model.get("dropout") or any(t["content"].isalpha() for t in spec["added_tokens"]):
        return frozenset()
    return frozenset(string.ascii_lowercase) | {chr(c) for c in range(0xDF, 0x100) if c != 0xF7}


class Encoder:
    """Ids of texts by one tokenizer file, without added tokens."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.chunked = drops_spaces(path)
        if path.endswith(".model"):
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: self.model.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_file(path)
            self.model.no_truncation()
            self.model.no_padding()
            self.encode = lambda texts: [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        self.letters = plain_letters(path) if self.chunked else frozenset()
        if self.letters:
            from tokenizers import pre_tokenizers

            as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.bytewise = {ord(c): as_bytes.pre_tokenize_str(c)[0][0] for c in self.letters}
            self.merge = self.model.model.tokenize
        self._start_anew()

    def largest_id(self) -> int:
        if hasattr(self.model, "get_vocab"):
            return max(self.model.get_vocab(with_added_tokens=True).values(), default=0)
        return self.model.vocab_size() - 1

    def _start_anew(self) -> None:
        self.places = Places()
        self.starts, self.flat = array("q", [0]), array("I")  # ids of place p: flat[starts[p] : starts[p + 1]]

    def _merged(self, word: str) -> list[int]:
        """The ids of a word of plain letters."""
        return [token.id for token in self.merge(word if word.isascii() else word.translate(self.bytewise))]

    def _learn(self) -> None:
        """Append the ids of all chunks that got a place since; the library's whole path sees each other part once."""
        flat, starts, places, plain = self.flat, self.starts, self.places, self.letters.issuperset
        split = {c: _parts(c) for c in places.new if not plain(c.decode())}
        found = len(places.new)
        for own in split.values():
            if len(own) > 1:
                for part in own:
                    if not plain(part.decode()):
                        places[part]
        whole = [own[0] for own in split.values() if len(own) == 1] + places.new[found:]
        ids: dict[bytes, list[int]] = {}
        for start in range(0, len(whole), 2_000):
            some = whole[start : start + 2_000]
            ids.update(zip(some, self.encode([p.decode() for p in some]), strict=True))
        for chunk in places.new:
            # what is made of a chunk is let go at once, so that no garbage is looked for
            for part in split.get(chunk) or (chunk,):
                at = places.get(part, len(starts))
                if part in ids:
                    flat.fromlist(ids[part])
                elif at < len(starts) - 1:
                    flat.extend(flat[starts[at] : starts[at + 1]])
                else:
                    flat.fromlist(self._merged(part.decode()))
            starts.append(len(flat))
        places.new.clear()

    def _look_up(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each text's chunks begin, the places of all chunks in a row, and the starts of places."""
        if self.places.full:
            self._start_anew()
        split = [_chunks(t) for t in texts]
        bounds = np.zeros(len(split) + 1, np.int64)
        np.cumsum([len(chunks) for chunks in split], out=bounds[1:])
        every = map(self.places.__getitem__, chain.from_iterable(split))
        found = np.fromiter(every, np.int64, int(bounds[-1]))
        if self.places.new:
            self._learn()
        return bounds, found, np.frombuffer(self.starts, np.int64)

    def ids(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """One array of ids per text; a null text has none."""
        if not self.chunked:
            return [np.array(x, np.uint32) for x in self.encode([t or "" for t in texts])]
        out: list[np.ndarray] = []
        for some in _batches(texts):
            bounds, places, starts = self._look_up(some)
            lengths = starts[places + 1] - starts[places]
            ends = np.cumsum(lengths)
            # position i of the row of ids lies in its chunk as far as it lies behind the chunk's first
            take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[places] - (ends - lengths), lengths)
            flat = np.frombuffer(self.flat, np.uint32)[take] if len(take) else np.zeros(0, np.uint32)
            out += np.split(flat, np.concatenate([[0], ends])[bounds[1:-1]])
            del starts  # the arrays can grow again
        return out

    def counts(self, texts: Sequence[str | None]) -> list[int]:
        """The number of ids of each text; a null text has none."""
        if not self.chunked:
            return [len(x) for x in self.encode([t or "" for t in texts])]
        out: list[int] = []
        for some in _batches(texts):
            bounds, places, starts = self._look_up(some)
            sums = np.concatenate([[0], np.cumsum(starts[places + 1] - starts[places])])
            out += np.diff(sums[bounds]).tolist()
            del starts
        return out


def _batches(texts: Sequence[str | None], most: int = 1_000_000):
    """Runs of texts of bounded length together, so that working arrays stay small."""
    some: list[str | None] = []
    size = 0
    for text in texts:
        some.append(text)
        size += len(text or "")
        if size >= most:
            yield some
            some, size = [], 0
    if some:
        yield some


_SIGNS = b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~|"


def _chunks(text: str | None) -> list[bytes]:
    """The chunks of a text, split at ASCII white space only, on which all classes agree.

    Texts of letters that all have one code point in normal form, and without added tokens, are
    lower-cased at once: the tokenizer does the same later.
    """
    text = text or ""
    if "<" not in text:
        if text.isascii():
            return text.lower().encode().split()
        try:
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            pass
    return text.encode().split()


def _parts(chunk: bytes) -> tuple[bytes, ...]:
    """A word with closing signs falls in two, if it ends in a letter as the tokenizer sees it."""
    word = chunk.rstrip(_SIGNS)
    if 0 < len(word) < len(chunk) and b"<" not in chunk:
        last = word.decode() if word.isascii() else unicodedata.normalize("NFC", word.decode()).lower()
        if last[-1].isalpha():
            return (word, chunk[len(word) :])
    return (chunk,)


def encoder(path: str) -> Encoder:
    """The encoder of this worker process."""
    return resident(("encoder", path), lambda: Encoder(path))
