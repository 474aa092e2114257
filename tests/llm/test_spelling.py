"""Spelling variants against brute force: every edit of every word, looked up among all words."""

import random
import re
from collections import Counter
from zlib import crc32

import pytest
from fixtures import awkward, clashing, empty, rows_of

from tallymark.llm import queries, spelling
from tallymark.llm.spelling import variants

FOLDER = "/root/testdata/sf0.01"
ALPHABET = [chr(c) for c in spelling.COUNTED]


def brute_words(rows) -> dict[str, int]:
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(words: dict[str, int], ratio: int = 5, near=None) -> list[tuple]:
    near = near or {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= ratio * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def by_edits(words) -> dict[str, list[str]]:
    """Near words by trying all edits."""
    out = {}
    for w in words:
        cuts = {w[:i] + w[i + 1 :] for i in range(len(w))}
        swaps = {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in ALPHABET}
        more = {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in ALPHABET}
        out[w] = [x for x in (cuts | swaps | more) - {w} if x in words]
    return out


def found(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in queries.table(spark, FOLDER, "documents").select("doc_id", "text").collect()]
    words = brute_words(rows)
    result = found(queries.op11_spelling_variants(spark, FOLDER))
    assert result == brute(words, near=by_edits(words))
    assert sum(r[1] is not None for r in result) > 20


@pytest.mark.parametrize("letters", ["ab", "abcdé", "abcdefghijkl"])
def test_many_blocks_and_letters_in_common(spark, letters, monkeypatch):
    chance = random.Random(len(letters))
    words = {"".join(chance.choice(letters) for _ in range(chance.randrange(1, 9))): chance.randrange(1, 2000) for _ in range(1200)}
    monkeypatch.setattr(spelling, "WORDS_PER_TASK", 3)  # so that words of equal letters are dealt
    original = spelling.near_letters
    monkeypatch.setattr(spelling, "near_letters", lambda places: original(places, sample=400, block=16))
    assert found(variants(spark.createDataFrame(list(words.items()), "word string, n long"))) == brute(words)


def test_one_edit_needs_the_order(spark):
    words = {"abcdef": 100, "bacdeg": 3, "abcdeg": 3, "abcdefg": 2, "gabcdef": 600, "agbdef": 1, "a": 9, "b": 1, "": 4, "ab": 1}
    expected = brute({w: n for w, n in words.items() if w})
    expected = sorted([*expected, ("", None, "", 4, 0, None)], key=repr)  # an empty word is near none
    assert found(variants(spark.createDataFrame(list(words.items()), "word string, n long"))) == expected


def test_long_words(spark):
    chance = random.Random(5)
    base = "".join(chance.choice("abcdé") for _ in range(3000))
    swapped = base[:1000] + base[1001] + base[1000] + base[1002:]
    words = {
        base: 100, base[:7] + "z" + base[8:]: 3, base[:2999]: 4, base[:1500] + "q" + base[1500:]: 700, swapped: 5, swapped[1:]: 1,
        "a" * 4000: 1, "a" * 4001: 9, "a" * 256: 1, "a" * 257: 5, "a" * 258: 25, "a" * 255 + "b": 6, "a" * 256 + "b": 60,
    }
    assert found(variants(spark.createDataFrame(list(words.items()), "word string, n long"))) == brute(words)


def test_odd_rows(spark):
    rows = [(None, 4), ("words", None), ("words", 3), ("words", 4), ("word", 1), ("Word", 7), ("wörd", 2), ("w0rd", 9), ("wоrd", 9), ("zero", 0)]
    result = found(variants(spark.createDataFrame(rows, "word string, n long")))
    expected = brute({"words": 7, "word": 1, "wörd": 2})
    expected += [(w, None, w, n, 0, None) for w, n in (("Word", 7), ("w0rd", 9), ("wоrd", 9))]
    assert result == sorted(expected, key=repr)
    with pytest.raises(ValueError):
        variants(spark.createDataFrame(rows, "word string, n long"), ratio=1)


@pytest.mark.parametrize("make", [awkward, lambda s: clashing(awkward(s))])
def test_awkward_documents(spark, make, tmp_path):
    docs = make(spark)
    path = str(tmp_path)
    docs.write.parquet(f"{path}/documents.parquet")
    words = brute_words((r.doc_id, r.text) for r in docs.collect())
    assert found(queries.op11_spelling_variants(spark, path)) == brute(words, near=by_edits(words))


def test_empty(spark):
    assert rows_of(variants(queries.planted_words(empty(spark)))) == []
    assert rows_of(variants(spark.createDataFrame([("alone", 5)], "word string, n long"))) == [("alone", None, "alone", 5, 0, None)]
