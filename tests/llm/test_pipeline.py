"""The pipeline's stages on a small table, each held against its operator or brute force."""

import random

import corpus_pipeline
import numpy as np
import pytest
from fixtures import DOCUMENTS, awkward, clashing, empty, prose
from test_duplicates import brute_documents
from tokenizers import Tokenizer

from tallymark.llm import queries
from tallymark.llm.mixing import mix
from tallymark.llm.vocab import tokenizer_path

FOLDER = "/root/testdata/sf0.01"


def test_stage_list():
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "language ID", "n-gram Jaccard join", "mixing sources", "packing"]


def test_filters_keep_clean_documents(spark):
    docs = queries.table(spark, FOLDER, "documents")
    labels = queries.table(spark, FOLDER, "labels")
    kept = corpus_pipeline.good(spark, docs, FOLDER)
    assert kept.columns == docs.columns
    left = kept.join(labels, "doc_id").groupBy("quality").count().collect()
    share = {r.quality: r["count"] / labels.filter(f"quality = {r.quality}").count() for r in left}
    assert share[1] >= 0.98 and share.get(0, 0) <= 0.1
    assert corpus_pipeline.identified(spark, kept, FOLDER).count() >= 0.98 * kept.count()


def test_one_document_of_each_group_stays(spark):
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents")
    kept = corpus_pipeline.distinct(spark, docs, FOLDER)
    expected = {k for k, (_, root) in brute_documents(docs.collect()).items() if k == root}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(expected)


def test_last_stages(spark):
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents")
    mixed = corpus_pipeline.weighted(spark, docs, FOLDER)
    assert mixed.count() == sum(r.copies for r in mix(docs).collect())
    pieces = corpus_pipeline.packed(spark, mixed, FOLDER).collect()
    plain = Tokenizer.from_file(tokenizer_path())
    wanted = sorted(x for r in mixed.collect() for x in [*plain.encode(r.text, add_special_tokens=False).ids, 2])
    assert sorted(x for p in pieces for x in np.frombuffer(p.ids, "<u4").tolist()) == wanted


@pytest.mark.parametrize("make", [awkward, empty, lambda spark: clashing(awkward(spark))])
def test_awkward_tables(spark, make):
    docs = make(spark)
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, FOLDER)
        rows = found.collect()
        assert name == "packing" or found.columns == docs.columns
        assert docs.count() or not rows
    if docs.count():
        kept = corpus_pipeline.distinct(spark, docs, FOLDER).collect()
        assert sorted(r.doc_id for r in kept if r.doc_id) == [1, 4, 5, 6, 7, 9, 11, 12, 13]


def brute_classes(texts: list[str]) -> list[int | None]:
    """The class of each text, a number, by comparing all shingle sets; None without shingles."""
    sets = []
    for text in texts:
        words = [w.lower() for w in (text or "").encode().split()]
        width = min(5, len(words))
        sets.append({tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set())
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) if sets[i] else None for i in range(len(texts))]


def test_a_group_of_repeated_and_null_ids_keeps_one(spark):
    x, y = prose(1, 100), prose(2, 100)
    near_y = y.replace(y.split()[50], "changed", 1)
    rows = [(5, x), (5, y), (9, near_y), (None, near_y), (None, prose(3, 80)), (None, prose(3, 80)), (7, None), (7, None), (8, ""), (5, x), (None, "a b")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], DOCUMENTS)
    kept = corpus_pipeline.distinct(spark, docs, FOLDER)
    assert kept.columns == docs.columns
    expected = [(5, x), (5, y), (None, prose(3, 80)), (7, None), (7, None), (8, ""), (None, "a b")]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(expected, key=repr)


def test_distinct_equals_brute_force_on_random_ids(spark):
    chance = random.Random(8)
    bases = [prose(k, 40) for k in range(6)]
    texts = [b.replace(b.split()[chance.randrange(40)], "other", chance.randrange(3)) for b in bases for _ in range(8)]
    rows = [(chance.choice((None, *range(6))), t) for t in texts]
    rows += chance.sample(rows, 10)
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], DOCUMENTS)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.distinct(spark, docs, FOLDER).collect()]
    number = dict(zip([t for _, t in rows], brute_classes([t for _, t in rows])))
    least = {}
    for i, t in rows:
        least[number[t]] = min(least.get(number[t], (True, 0)), (i is None, i or 0))
    assert sorted(number[t] for _, t in kept) == sorted(set(number.values()))  # one of each class
    assert all((i is None, i or 0) == least[number[t]] for i, t in kept)  # and the one of the smallest id
