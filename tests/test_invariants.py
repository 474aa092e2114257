"""Properties that hold for whole tables."""

import pytest

from tallymark.catalog.base import orders_pair, orders_spec, spec
from tallymark.plans.reconcile import reconcile

FOLDER = "/root/testdata/sf0.1"


def thinned(spark, folder):
    """The orders pair with rows left out on both sides."""
    source, target = orders_pair(spark, folder)
    target = target.filter("order_id >= 0")  # the re-keyed rows are the keys divisible by 10
    return source.filter("o_orderkey % 17 <> 0"), target


@pytest.mark.parametrize(
    "folder, expected, matches",
    [
        ("/root/testdata/sf0.001", (1411, 1350, 954, 316, 80, 141), (1203, 1088, 1172, 1270)),
        ("/root/testdata/sf0.01", (14117, 13500, 9523, 3183, 794, 1411), (12037, 10892, 11729, 12706)),
        ("/root/testdata/sf0.1", (141176, 135000, 95240, 31819, 7941, 14117), (120372, 108907, 117285, 127059)),
    ],
)
def test_known_counts(spark, folder, expected, matches):
    result = reconcile(*thinned(spark, folder), orders_spec())
    assert tuple(result.summary().first())[:6] == expected
    found = {r["field"]: r["matches"] for r in result.field_stats().collect()}
    assert (found["status"], found["price"], found["priority"], found["order_date"]) == matches


def test_counts_add_up(spark):
    result = reconcile(*orders_pair(spark, FOLDER), orders_spec())
    row = result.summary().first()
    assert row["matched"] + row["different"] + row["missing_in_target"] == row["total_source"]
    assert row["matched"] + row["different"] + row["missing_in_source"] == row["total_target"]
    for field in result.field_stats().collect():
        assert field["matches"] + field["differences"] == field["comparable"]
    assert result.breaks().select("o_orderkey").distinct().count() == row["different"]


def test_swapping_sides_swaps_the_missing(spark):
    source, target = orders_pair(spark, FOLDER)
    one = reconcile(source, target, spec({"name": "price", "source": "o_totalprice", "tolerance": 0.01}))
    key = {"name": "o_orderkey", "source": "order_id", "target": "o_orderkey"}
    field = {"name": "price", "target": "o_totalprice", "tolerance": 0.01}
    two = reconcile(target, source, spec(field, keys=[key]))
    a, b = one.summary().first(), two.summary().first()
    assert (a["matched"], a["different"]) == (b["matched"], b["different"])
    assert (a["missing_in_source"], a["missing_in_target"]) == (b["missing_in_target"], b["missing_in_source"])


def test_core_plan_has_one_join_and_reads_only_needed_columns(spark, capsys):
    result = reconcile(*orders_pair(spark, FOLDER), spec({"name": "price", "source": "o_totalprice"}))
    result.summary().explain("formatted")
    plan = capsys.readouterr().out
    assert plan.count("SortMergeJoin FullOuter") == 1
    schemas = {line for line in plan.splitlines() if line.startswith("ReadSchema")}
    assert schemas <= {"ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>", "ReadSchema: struct<>"}


def test_bucketed_tables_join_without_an_exchange(spark, capsys, tmp_path):
    source, target = orders_pair(spark, "/root/testdata/sf0.001")
    renamed = target.withColumnRenamed("order_id", "o_orderkey")
    for name, df in (("bucketed_source", source), ("bucketed_target", renamed)):
        writer = df.write.mode("overwrite").option("path", str(tmp_path / name))
        writer.bucketBy(8, "o_orderkey").sortBy("o_orderkey").saveAsTable(name)
    try:
        tables = [spark.table("bucketed_source"), spark.table("bucketed_target")]
        wanted = spec({"name": "price", "source": "o_totalprice"}, keys=["o_orderkey"])
        result = reconcile(*tables, wanted, null_keys="differ")
        result.classified().explain("formatted")
        assert "Exchange" not in capsys.readouterr().out
        plain = reconcile(*tables, wanted)
        assert result.summary().first() == plain.summary().first()
    finally:
        spark.sql("drop table bucketed_source")
        spark.sql("drop table bucketed_target")
