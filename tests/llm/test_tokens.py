"""Token counts, packing and record files against the tokenizer itself."""

import json
import random
import zlib

import numpy as np
import pytest
from fixtures import awkward, clashing, empty, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallymark.llm.packing import fill, pack, pack_pool, windows
from tallymark.llm.record_files import POLYNOMIAL, crc32c, frame, read_records, unframe, write_records
from tallymark.llm.shared import new_path
from tallymark.llm.token_counts import count_tokens, read_cache
from tallymark.llm.vocab import Encoder, drops_spaces, encoder, file_digest, plain_letters, tokenizer_path

PATH = tokenizer_path()


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def ids_of(plain, text):
    return plain.encode(text or "", add_special_tokens=False).ids


ODD = ["H̱ x", "<|endoftext|>a <|ENDOFTEXT|>b", "don't I'LL 'S x\x1cy\x85z", "ΑΣ. İ ȧ,", "12a3b.,c", "한가", " 　y", "a\x00b"]


@pytest.mark.parametrize("text", ODD)
def test_chunks_encode_like_whole_texts(plain, text):
    assert list(encoder(PATH).ids([text])[0]) == ids_of(plain, text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aZé'ßİ.,!<|> \n\t́ 1x_sdtΣ"), max_size=30), max_size=4))
def test_any_text_encodes_like_the_library(texts):
    plain = Tokenizer.from_file(PATH)
    assert [list(x) for x in encoder(PATH).ids(texts)] == [ids_of(plain, t) for t in texts]
    assert encoder(PATH).counts(texts) == [len(ids_of(plain, t)) for t in texts]


def test_cache_starts_anew_when_full(plain, monkeypatch):
    monkeypatch.setattr("tallymark.llm.resident.CACHE_BYTES", 500)
    own = Encoder(PATH)
    for text in ["one two three four five", "six two", "one. two, Three"]:
        assert list(own.ids([text])[0]) == ids_of(plain, text)


def test_plain_words_go_straight_to_the_model(plain):
    own, seen = Encoder(PATH), []
    whole = own.encode
    own.encode = lambda texts: seen.extend(texts) or whole(texts)
    for text in ["The naïve Straße, word's end! (odd) x1", "word, naïve. end, ωmega"]:
        assert list(own.ids([text])[0]) == ids_of(plain, text)
    assert sorted(seen) == sorted(["word's", "(odd", ")", "x1", "ωmega", ",", "!", "."])


def test_words_go_straight_only_where_the_file_allows_it(tmp_path):
    assert plain_letters(PATH) >= set("azßé") and not plain_letters(PATH) & set("A1÷'ā")
    with open(PATH, encoding="utf-8") as file:
        spec = json.load(file)

    def changed(change):
        other = json.loads(json.dumps(spec))
        change(other)
        path = tmp_path / "other.json"
        path.write_text(json.dumps(other))
        return plain_letters(str(path))

    assert changed(lambda s: None)
    assert not changed(lambda s: s["normalizer"]["normalizers"].append({"type": "NFD"}))
    assert not changed(lambda s: s["model"].update(dropout=0.1))
    assert not changed(lambda s: s["added_tokens"][0].update(content="abc"))
    assert not changed(lambda s: s["pre_tokenizer"]["pretokenizers"][1].update(use_regex=True))
    assert not changed(lambda s: s["pre_tokenizer"]["pretokenizers"][0]["pattern"].update(Regex="[\\p{N}]"))


def test_only_tokenizers_that_drop_spaces_are_chunked():
    assert drops_spaces(PATH)
    assert not drops_spaces(tokenizer_path("byte_bpe_50k.json"))
    assert not drops_spaces(tokenizer_path("piece_bpe_32k.model"))


def test_other_tokenizers_encode_whole_texts():
    path = tokenizer_path("byte_bpe_50k.json")
    other = Tokenizer.from_file(path)
    texts = ["a  b\n c", None, "été"]
    assert encoder(path).counts(texts) == [len(other.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert encoder(tokenizer_path("piece_bpe_32k.model")).counts(["a b", None])[1] == 0


def test_counts(spark, plain):
    docs = awkward(spark)
    found = count_tokens(clashing(docs), PATH, new_path(spark, "t"))
    expected = [(r.doc_id, len((r.text or "").encode()), len(ids_of(plain, r.text))) for r in docs.collect()]
    assert rows_of(found) == sorted(expected, key=repr)


def test_cache_keeps_counts_and_encodes_only_misses(spark):
    cache = new_path(spark, "t")
    docs = awkward(spark).filter("doc_id < 10")
    first = rows_of(count_tokens(docs, PATH, cache))
    stored = read_cache(spark, cache, file_digest(PATH)).count()
    assert stored == len({" ".join((r.text or "").split()) for r in docs.collect()})
    # a stored count is believed: it is not encoded again
    marked = spark.createDataFrame([(r.content, 7, file_digest(PATH)) for r in read_cache(spark, cache, file_digest(PATH)).collect()],
                                   "content string, n_tokens long, tokenizer string")
    other = new_path(spark, "t")
    marked.write.partitionBy("tokenizer").parquet(other)
    assert {n for _, _, n in rows_of(count_tokens(docs, PATH, other))} == {7}
    assert rows_of(count_tokens(docs, PATH, cache)) == first
    assert read_cache(spark, cache, file_digest(PATH)).count() == stored
    assert read_cache(spark, cache, "another version").count() == 0


@given(st.lists(st.integers(1, 40), max_size=12), st.integers(0, 60))
@settings(max_examples=300, deadline=None)
def test_fill_is_the_best_subset(lengths, room):
    counts = {n: lengths.count(n) for n in lengths}
    taken = fill(counts, room)
    sums = {0}
    for n in lengths:
        sums |= {s + n for s in sums if s + n <= room}
    assert sum(n * k for n, k in taken.items()) == max(sums)
    assert all(k <= counts[n] for n, k in taken.items())


def test_fill_takes_the_same_from_known_lengths():
    chance = random.Random(2)
    for _ in range(50):
        counts = {chance.randrange(1, 60): chance.randrange(4) for _ in range(12)}
        assert fill(counts, 50, sorted(n for n in counts if n <= 50)) == fill(counts, 50)


def test_windows_take_each_item_once():
    chance = random.Random(5)
    lengths = [chance.randrange(1, 100) for _ in range(500)] + [60] * 300
    filled, rest = windows(lengths, 100, 2)
    assert sorted([i for w in filled for i in w] + rest) == list(range(len(lengths)))
    assert all(98 <= sum(lengths[i] for i in w) <= 100 for w in filled)


def test_pool_without_padding_at_its_end():
    pieces = list(pack_pool([np.zeros(n, np.uint32) for n in (250, 33, 70, 70, 1)], 100, 0))
    used = {}
    for _, _, length, sequence, offset, padded in pieces:
        assert offset == used.get(sequence, (0, 0))[0]
        used[sequence] = (offset + length, padded)
    assert all(end == padded for end, padded in used.values())


@pytest.mark.parametrize("capacity, pool", [(4096, 16_000_000), (64, 300)])
def test_packing_covers_every_id_once(spark, plain, capacity, pool):
    docs = awkward(spark)
    pieces = pack(clashing(docs), PATH, capacity=capacity, slack=4, pool_tokens=pool).collect()
    wanted = sorted((str(r.doc_id), tuple([*ids_of(plain, r.text), 2])) for r in docs.collect())
    by_id: dict = {}
    for p in pieces:
        assert len(p.ids) == 4 * p.length
        by_id.setdefault(str(p.doc_id), []).append((p.doc_tokens, p.start, tuple(np.frombuffer(p.ids, "<u4").tolist())))
    for key in by_id:
        own = [ids for k, ids in wanted if k == key]
        assert sorted(x for _, _, ids in by_id[key] for x in ids) == sorted(x for ids in own for x in ids)
        for n, start, ids in by_id[key]:
            assert any(len(o) == n and o[start : start + len(ids)] == ids for o in own)
    assert set(by_id) == {k for k, _ in wanted}
    sequences: dict = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        end, _ = sequences.get(p.sequence_id, (0, 0))
        assert p.offset == end
        sequences[p.sequence_id] = (end + p.length, p.padded_to)
    assert all(end <= padded <= capacity and (padded == capacity or end == padded) for end, padded in sequences.values())


def slow_crc(data):
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = (crc >> 1) ^ (POLYNOMIAL if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_checksums():
    assert crc32c([b"123456789"])[0] == 0xE3069283
    parts = [bytes(i * 7 % 256 for i in range(n)) for n in (4, 5, 255, 256, 257, 700, 1024)]
    assert crc32c(parts).tolist() == [slow_crc(p) for p in parts]


def test_broken_records_raise():
    record = frame([b"x" * 40])[0]
    assert unframe([record]) == [b"x" * 40]
    with pytest.raises(ValueError):
        unframe([record[:20] + b"y" + record[21:]])
    with pytest.raises(ValueError):
        unframe([record[:-1]])


def test_records_round_trip(spark, plain):
    docs = awkward(spark)
    folder = new_path(spark, "t")
    index = write_records(clashing(docs), PATH, folder)
    found = read_records(index, folder).collect()
    wanted = sorted(((r.doc_id is not None, r.doc_id or 0), [*ids_of(plain, r.text), 2]) for r in docs.collect())
    got = sorted((r.start, (r.doc_id is not None, r.doc_id or 0), np.frombuffer(r.ids, "<u4").tolist()) for r in found)
    assert sorted((k, ids) for _, k, ids in got) == wanted
    assert [k for _, k, _ in got] == sorted(k for _, k, _ in got)
    before = 0
    for start, _, ids in got:
        assert start == before
        before += len(ids)


def test_shuffled_reads_find_the_same_records(spark):
    folder = new_path(spark, "t")
    index = write_records(awkward(spark), PATH, folder)
    shuffled = read_records(index.orderBy("size", "position").filter("size % 2 = 0"), folder)
    every = {(r.start, r.n_tokens, zlib.crc32(r.ids)) for r in read_records(index, folder).collect()}
    some = [(r.start, r.n_tokens, zlib.crc32(r.ids)) for r in shuffled.collect()]
    assert set(some) <= every and len(some) == index.filter("size % 2 = 0").count()


def test_records_of_a_large_vocabulary(spark, tmp_path):
    """Ids above 65,535 take 4 bytes; where they are told to take 2, they raise."""
    spec = {"version": "1.0", "added_tokens": [], "pre_tokenizer": {"type": "Whitespace"}}
    spec["model"] = {"type": "WordLevel", "vocab": {"?": 0, "far": 70_000}, "unk_token": "?"}
    path = tmp_path / "large.json"
    path.write_text(json.dumps(spec))
    docs = spark.createDataFrame([(1, "far off far")], "doc_id long, text string")
    folder = new_path(spark, "t")
    found = read_records(write_records(docs, str(path), folder), folder).collect()
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in found] == [[70_000, 0, 70_000, 2]]
    with pytest.raises(Exception, match="does not fit"):
        write_records(docs, str(path), new_path(spark, "t"), vocabulary=1 << 16)


def test_empty_tables(spark):
    folder = new_path(spark, "t")
    index = write_records(empty(spark), PATH, folder)
    assert read_records(index, folder).collect() == []
    assert pack(empty(spark), PATH).collect() == []
    assert count_tokens(empty(spark), PATH, new_path(spark, "t")).collect() == []


def test_pools_are_bounded_by_rows_and_numbered_on(spark):
    """Many pools in one partition: windows of different pools never share a number."""
    docs = spark.createDataFrame([(i, "word " * (i % 7)) for i in range(3000)], "doc_id long, text string").coalesce(1)
    pieces = pack(docs, tokenizer_path(), capacity=16, slack=2, pool_rows=5, pool_tokens=40).collect()
    taken = {}
    for p in pieces:
        taken.setdefault(p.sequence_id, []).append(p)
    assert len(taken) > 600
    for own in taken.values():
        ends = [0]
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == ends[-1]
            ends.append(p.offset + p.length)
        assert ends[-1] <= own[0].padded_to <= 16 and len({p.padded_to for p in own}) == 1
    assert sum(p.length for p in pieces) == sum(i % 7 + 1 for i in range(3000))
