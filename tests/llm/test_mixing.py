"""Mixing: targets by hand, thresholds against SQL, the given rows kept whole."""

import os

import pytest
from fixtures import awkward, clashing, empty, prose, rows_of
from oracle import connect, differences
from pyspark.sql import functions as F

from tallymark.llm import queries
from tallymark.llm.mixing import mix, mixed

FOLDER = os.environ.get("LLM_SF_DIR", "/root/testdata/sf0.01")


def test_against_sql(spark):
    name = "op3_hash_threshold_mix"
    assert differences(queries.QUERIES[name](spark, FOLDER), connect(FOLDER), queries.ORACLE[name]) == []


def shares(sizes: list[int], weights, share: float, limit: float) -> list[float]:
    """Shares by pouring what is left over, round by round."""
    target, full, left = [0.0] * len(sizes), set(), share * sum(sizes)
    while left > 1e-9 and len(full) < len(sizes):
        open_ = [i for i in range(len(sizes)) if i not in full]
        total = sum(weights[i % len(weights)] for i in open_)
        for i in open_:
            target[i] += left * weights[i % len(weights)] / total
        left = 0.0
        for i in open_:
            if target[i] > limit * sizes[i]:
                left += target[i] - limit * sizes[i]
                target[i] = limit * sizes[i]
                full.add(i)
    return target


@pytest.mark.parametrize("sizes", [[100, 100, 100], [10, 500, 500, 20, 30], [1000, 1], [3, 0, 7, 40]])
def test_targets(spark, sizes):
    rows = [(10_000 * s + i, prose(i, 1), "en", f"s{s}", 1) for s, n in enumerate(sizes) for i in range(n)]
    rows += [(1_000_000 + s, None, "en", f"s{s}", 0) for s in range(len(sizes))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = mix(docs).groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.max("copies").alias("most"))
    expected = sorted(shares(sizes, (5, 2, 1), 1.5, 2.0))
    named = mix(docs).join(docs.select("doc_id", "source").distinct(), "doc_id").groupBy("source").agg(
        F.first("target").alias("target"), F.sum("taken").alias("taken"), F.max("copies").alias("most")
    ).collect()
    assert sorted(r.target for r in named) == pytest.approx(expected)
    assert all(r.most <= 2 for r in found.collect())


def test_sources_are_taken_near_their_targets(spark):
    docs = queries.table(spark, FOLDER, "documents")
    sizes = mix(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(
        F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("longest")
    )
    assert all(abs(r.taken - r.target) <= r.longest / 2 + 1 for r in sizes.collect())


def test_reruns_and_partitions_agree(spark):
    docs = awkward(spark)
    assert rows_of(mix(docs)) == rows_of(mix(docs.repartition(5))) == rows_of(mix(clashing(docs)))
    assert rows_of(mix(docs)) != rows_of(mix(docs, seed="other")) or docs.count() < 3


def test_larger_budgets_take_supersets(spark):
    docs = queries.table(spark, FOLDER, "documents")
    small, large = ({r.doc_id: r.copies for r in mix(docs, share=s, weights=(1,)).collect()} for s in (0.4, 0.7))
    assert all(large[k] >= n for k, n in small.items())


def test_rows_are_repeated_as_often_as_taken(spark):
    docs = awkward(spark)
    copies = sum(r.copies for r in mix(docs).collect())
    found = mixed(clashing(docs))
    assert found.columns == clashing(docs).columns and found.count() == copies


def test_empty(spark):
    assert mix(empty(spark)).collect() == [] and mixed(empty(spark)).collect() == []
    blank = awkward(spark).filter("doc_id in (4, 5, 6)")
    assert [r.taken for r in mix(blank).collect()] == [0, 0, 0]
