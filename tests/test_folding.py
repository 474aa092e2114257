"""Groups, joins and pairs are dealt over tasks by the number of rows, with the same results."""

import pytest
from helpers import frame, spec
from pyspark.sql import functions as F

from tallymark.operators import folding
from tallymark.operators.folding import count_equal
from tallymark.operators.joins import TASK_PAIRS
from tallymark.plans.reconcile import Skew, reconcile


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr(folding, "TASK_ROWS", 40)
    monkeypatch.setattr(folding, "LEAST_BYTES", 0)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def counted(df):
    return sorted(map(str, df.collect()))


def test_classified_rows_folded(spark):
    """Equal pairs are one row with their number, however many there are."""
    source = spark.range(300_000).selectExpr("1 as k", "'x' as v").union(spark.range(5).selectExpr("id + 5 as k", "'y' as v"))
    target = spark.range(200_000).selectExpr("1 as k", "if(id % 2 = 0, 'x', 'z') as v")
    result = reconcile(source, target, spec({"name": "v"}, keys=["k"]), skew=Skew("always", share=0.1, min_rows=20))
    found = [(r["category"], r["records"]) for r in result.classified(folded=True).collect()]
    assert sorted(found) == [("different", 3 * 10**10), ("matched", 3 * 10**10), *[("missing_in_target", 1)] * 5]


def test_pairs_of_a_hot_key_are_formed_by_several_tasks(spark):
    source = spark.range(6000).selectExpr("1 as k", "'x' as v")
    target = spark.range(6000).selectExpr("1 as k", "'x' as v")
    skew = Skew("always", share=0.1, min_rows=20, rows_per_cell=500)
    result = reconcile(source, target, spec({"name": "v"}, keys=["k"]), skew=skew)
    tasks = result.classified().groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) > 2 and max(r["count"] for r in tasks) <= 5 * TASK_PAIRS and sum(r["count"] for r in tasks) == 36_000_000


def test_duplicate_keys_are_dealt_by_rows(spark, small_tasks):
    rows = [(None if i % 7 == 0 else i % 90, f"n{i % 2}", float(i)) for i in range(400)]
    source = frame(spark, "k long, j string, v double", *rows)
    result = reconcile(source, source, spec({"name": "v"}, keys=["k", "j"])).duplicate_keys()
    expected = source.groupBy("k", "j").count().filter("count > 1")
    expected = [expected.withColumn("side", F.lit(side)) for side in ("source", "target")]
    assert counted(result) == sorted(str(r).replace("count=", "row_count=") for e in expected for r in e.collect())
    assert "REPARTITION_BY_NUM" in plan(result)


def test_floating_keys_are_one_group(spark, small_tasks):
    values = [(0.0,), (-0.0,), (float("nan"),), (float("nan"),), (None,)] * 40
    found = {str(r["v"]): r["rows"] for r in count_equal(frame(spark, "v double", *values), 200).collect()}
    assert found == {"0.0": 80, "nan": 80, "None": 40}


def test_alternative_keys_are_dealt_by_rows(spark, small_tasks, monkeypatch):
    target = frame(spark, "k long, a long, v long", *[(None if i % 50 == 0 else i, i % 3 and (i * 7 % 500 if i % 4 else None), i) for i in range(300)])
    source = frame(spark, "k long, v long", *[(i if i % 20 else None, i) for i in range(400)])
    wanted = spec({"name": "v"}, keys=[{"name": "k", "target_alternatives": ["a"]}])
    for drop in (False, True):
        dealt = reconcile(source, target, wanted, drop_null_alternatives=drop, skew="always").merged()
        text = plan(dealt)
        found = counted(dealt)
        with monkeypatch.context() as m:
            m.setattr(folding, "TASK_ROWS", 10**9)
            assert found == counted(reconcile(source, target, wanted, drop_null_alternatives=drop, skew="ignore").merged())
        assert text.count("REPARTITION_BY_NUM") >= 3


def test_near_values_are_counted_by_rows(spark, small_tasks):
    source = frame(spark, "k string, v double, w string", *[("a", i * 1.5, f"w{i % 3}") for i in range(200)])
    target = frame(spark, "k string, v double, w string", *[("a", i * 1.1, f"w{i % 2}") for i in range(150)])
    wanted = spec({"name": "v", "tolerance": 2}, {"name": "w"}, keys=["k"])
    split = reconcile(source, target, wanted, skew=Skew("always", share=0.05, min_rows=50))
    plain = reconcile(source, target, wanted, skew="ignore")
    assert split.hot_keys and counted(split.field_stats()) == counted(plain.field_stats())
    assert split.summary().first() == plain.summary().first()
    assert "REPARTITION_BY_NUM" in plan(split.field_stats())
