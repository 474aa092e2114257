"""Similarity joins and neighbours against brute force."""

import itertools
import os
import random

import numpy as np
import pytest
from fixtures import DOCUMENTS, WORDS, awkward, clashing, empty, prose, rows_of

from tallymark.llm import neighbours, queries
from tallymark.llm.embedding_dedup import link_vectors, span
from tallymark.llm.graph import components
from tallymark.llm.neighbours import nearest
from tallymark.llm.ngram_join import link_components, most_common, parity, shingles

SMALL = os.environ.get("LLM_SMALL_DIR", "/root/testdata/sf0.001")


def roots(nodes, links) -> dict:
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


def shingle_set(text) -> frozenset:
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_documents(rows) -> dict:
    sets = {r.doc_id: shingle_set(r.text) for r in rows}
    links = [
        (a, b) for a, b in itertools.combinations(sets, 2)
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and sets[b]
    ]
    return {k: (len(sets[k]), root) for k, root in roots(sets, links).items()}


def check_documents(docs):
    rows = docs.filter("doc_id is not null").collect()
    expected = brute_documents(rows)
    found = [r for r in link_components(docs).collect() if r.doc_id is not None]
    assert len(found) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == expected


def test_documents_of_the_table(spark):
    check_documents(queries.table(spark, SMALL, "documents"))


def test_documents_near_the_bar(spark):
    """Copies with ever more words changed lie on both sides of the similarity, and link in chains."""
    chance = random.Random(11)
    rows = []
    for base in range(6):
        words = prose(base, chance.choice([4, 5, 9, 40, 200])).split()
        for copy in range(12):
            own = list(words)
            for _ in range(copy % 6):
                own[chance.randrange(len(own))] = f"x{chance.randrange(5)}"
            rows.append((len(rows), " ".join(own), "en", "s", 1))
    check_documents(spark.createDataFrame(rows, DOCUMENTS))


def test_shared_passages_do_not_link(spark):
    passage = prose(99, 60)
    rows = [(i, f"{prose(i, 100)} {passage} {prose(1000 + i, 100)}", "en", "s", 1) for i in range(60)]
    check_documents(spark.createDataFrame(rows, DOCUMENTS))


def test_short_vocabulary(spark):
    """Few words, so that most shingles are frequent and repeat within texts."""
    chance = random.Random(4)
    rows = [(i, " ".join(chance.choice(WORDS[:2]) for _ in range(chance.randrange(1, 14))), "en", "s", 1) for i in range(120)]
    check_documents(spark.createDataFrame(rows, DOCUMENTS))


def test_awkward_documents(spark):
    docs = awkward(spark)
    check_documents(docs)
    assert rows_of(link_components(docs)) == rows_of(link_components(clashing(docs).repartition(6)))
    assert link_components(empty(spark)).collect() == []


def test_shingles_ignore_case_of_ascii_only():
    assert (shingles("A b C d E f") == shingles("a  B\tc D\ne F")).all()
    assert len(shingles("É b c d e")) == 1 and shingles("É b c d e")[0] != shingles("é b c d e")[0]
    assert len(shingles("a b a b a b a b")) == 2 and len(shingles(None)) == 0
    assert shingles("a b")[0] != shingles("b a")[0]


def test_parities_never_deny_common_shingles():
    chance = random.Random(2)
    for _ in range(300):
        words = [prose(chance.randrange(99), chance.randrange(1, 400)) for _ in range(3)]
        x, y = shingles(words[0] + " " + words[1]), shingles(words[0] + " " + chance.choice(words[1:]))
        common = len(np.intersect1d(x, y))
        bound = most_common(len(x), parity(x), len(y), parity(y))
        assert common <= bound
        assert len(x) < 50 or len(y) < 50 or bound <= common + (len(x) + len(y) - 2 * common) // 2


@pytest.mark.parametrize("links", [[(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(5, 3), (3, 9), (9, 5), (20, 21)], []])
@pytest.mark.parametrize("per_task", [400_000, 7])
def test_components(spark, monkeypatch, links, per_task):
    monkeypatch.setattr("tallymark.llm.graph.LINKS_PER_TASK", per_task)
    shuffled = links[:]
    random.Random(1).shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "a long, b long")
    nodes = {n for link in links for n in link}
    assert {r.node: r.root for r in components(df, "t").collect()} == roots(nodes, links)


def test_span_connects_alike():
    pairs = np.array([[0, 1], [1, 2], [0, 2], [4, 5]])
    assert len(span(pairs, 6)) == 3


VECTORS = "vec_id long, embedding array<double>, label int"


def vectors(spark, seed=0, n=400, dims=6):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 8, dims))
    rows = [(i, (base[i % len(base)] * rng.uniform(0.5, 2) + rng.normal(0, 0.08, dims)).tolist(), int(i % 3)) for i in range(n)]
    rows += [(n + i, rows[0][1], 0) for i in range(30)]
    odd = [None, [], [0.0] * dims, [None] + [1.0] * (dims - 1), [float("nan")] * dims, [float("inf")] + [1.0] * (dims - 1)]
    rows += [(1000 + i, v, 0) for i, v in enumerate(odd)]
    rows += [(2000, rows[0][1], None), (rows[1][0], rows[1][1], rows[1][2]), (None, rows[0][1], 0)]
    return spark.createDataFrame(rows, VECTORS)


def fine(v) -> bool:
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def test_vector_links(spark):
    df = vectors(spark)
    rows = [r for r in df.collect() if r.vec_id is not None]
    part = [r for r in rows if r.label is not None and fine(r.embedding)]
    x = np.array([r.embedding for r in part])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r.label for r in part])
    hit = (x @ x.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(hit, False)
    ids = [r.vec_id for r in part]
    top = roots({r.vec_id for r in rows}, [(ids[i], ids[j]) for i, j in zip(*np.nonzero(hit), strict=True)])
    expected = sorted((r.vec_id, int(n), top[r.vec_id], top[r.vec_id] == r.vec_id) for r, n in zip(part, hit.sum(1), strict=True))
    expected += [(r.vec_id, 0, r.vec_id, True) for r in rows if r not in part]
    found = link_vectors(df)
    assert sorted(tuple(r) for r in found.collect() if r.vec_id is not None) == sorted(expected)
    assert [tuple(r) for r in found.filter("vec_id is null").collect()] == [(None, 0, None, True)]
    assert sum(hit.sum(1)) > 900  # the case is not an empty one


def test_vector_blocks_meet(spark, monkeypatch):
    """Small blocks, so that links cross blocks, partitions and intervals."""
    monkeypatch.setattr("tallymark.llm.embedding_dedup.BLOCK", 16)
    monkeypatch.setattr("tallymark.llm.embedding_dedup.RUN", 4)
    test_vector_links(spark)


def test_no_vectors(spark):
    none = spark.createDataFrame([], VECTORS)
    assert link_vectors(none).collect() == [] and nearest(none, "vec_id % 2 = 0").collect() == []


def brute_nearest(rows, queries_, k):
    part = [r for r in rows if r.vec_id is not None and fine(r.embedding)]
    out = {}
    for q in (r for r in part if r.vec_id in queries_):
        scored = sorted(((-float(np.dot(q.embedding, r.embedding)), r.vec_id) for r in part if r.vec_id != q.vec_id))
        out[q.vec_id] = [(i, -s) for s, i in scored[:k]]
    return out


def test_nearest_of_few_are_exact(spark):
    """Lengths differ, copies tie, and there are fewer candidates than asked for."""
    df = vectors(spark, n=64)
    df = df.dropDuplicates(["vec_id", "embedding"]).filter("vec_id is null or vec_id <> 1 or label is not null")
    found: dict = {}
    for r in nearest(df, "vec_id % 5 = 0", k=500).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    expected = brute_nearest(df.collect(), {r.vec_id for r in df.filter("vec_id % 5 = 0").collect()}, 500)
    assert {q: len(v) for q, v in found.items()} == {q: len(v) for q, v in expected.items()}
    for q, own in found.items():
        assert [i for i, _ in own] == [i for i, _ in expected[q]] or np.allclose([s for _, s in own], [s for _, s in expected[q]])
        assert np.allclose([s for _, s in own], [s for _, s in expected[q]], rtol=1e-12)


def test_nearest_recall(spark):
    """Recall of at least 0.9 on the given table, scores and order exact."""
    df = queries.table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = {r.vec_id: np.array(r.embedding, float) for r in df.collect()}
    ids, x = np.array(list(rows)), np.stack(list(rows.values()))
    hits = total = 0
    found: dict = {}
    for r in queries.QUERIES["op8_nn_descent_search"](spark, "/root/testdata/sf0.1").collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == {i for i in rows if i % 20 == 0}
    for q, own in found.items():
        own.sort()
        score = x @ rows[q]
        score[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -score))[:20]]
        hits, total = hits + len({i for _, i, _ in own} & set(best.tolist())), total + 20
        assert [r for r, _, _ in own] == list(range(1, 21))
        assert np.allclose([s for _, _, s in own], [rows[i] @ rows[q] for _, i, _ in own], rtol=1e-12)
    assert hits >= 0.9 * total


def measured_recall(spark, x, every: int, until: int | None = None, k: int = 20, **options) -> float:
    """Recall@k of the vectors whose ids are divisible by ``every``, or those of them below ``until``."""
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found: dict = {}
    for r in nearest(df, f"vec_id % {every} = 0", k=k, **options).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    own = range(0, until or len(x), every)
    for q in own:
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(found[q] & set(np.argsort(-score, kind="stable")[:k].tolist()))
    return hits / (k * len(own))


@pytest.mark.parametrize("spread", [0.0, 0.5])
def test_the_walk_alone_finds_the_nearest(spark, monkeypatch, spread):
    """Only the sample and the queries in doubt meet all vectors, whatever the vectors' lengths; the result is the walk's."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(10_000, 64))
    x *= np.exp(rng.normal(0, spread, (10_000, 1))) / np.linalg.norm(x, axis=1, keepdims=True)
    scanned, whole = [], neighbours.scan
    monkeypatch.setattr(neighbours, "scan", lambda some, *rest: (scanned.append(some.count()), whole(some, *rest))[1])
    assert measured_recall(spark, x, 50, sample=60) >= 0.95
    assert scanned[0] == 60 and sum(scanned[1:]) <= 10, scanned


def test_nearest_recall_of_near_copies(spark):
    """8 bits do not tell which of many near copies are nearest; they are too few to show in the recall of the sample."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6000, 64))
    x[:300] = x[0] + 0.03 * rng.normal(size=(300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert measured_recall(spark, x, 10, until=300, sample=100) >= 0.9


def test_nearest_recall_of_a_coarse_graph(spark):
    """A beam and a graph that find too little, as fixed ones do in large tables, are noticed and made up for."""
    x = np.random.default_rng(7).normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert measured_recall(spark, x, 20, k=2, degree=8, beam=5, most_rounds=0, sample=60) >= 0.9


@pytest.mark.parametrize("size", [1e-200, 1e-160, 1e160, 1e200])
def test_tiny_and_huge_vectors(spark, size):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) * size for v in rng.normal(0, 1, 8)], 1) for i in range(40)]
    rows += [(100 + i, [v * 3.0 for v in rows[i][1]], 1) for i in range(10)]
    found = link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.vec_id: r.component_id for r in found if r.vec_id >= 100} == {100 + i: i for i in range(10)}
    assert sum(r.n_links for r in found) == 20
