"""Data and specs off the tidy path."""

from __future__ import annotations

import datetime
from decimal import Decimal

import pytest
from helpers import column, counts, frame, spec
from pyspark.sql import types as T

from tallymark.functions.values import held_as
from tallymark.operators.lookup import append_aggregate, append_columns
from tallymark.operators.mapping import map_values
from tallymark.plans.reconcile import reconcile
from tallymark.sources.readers import read_csv, read_text_csv, unreadable_cells


def test_padded_keys_keep_each_left_row_once(spark):
    left = frame(spark, "k string", ("A",), ("B",))
    right = frame(spark, "k string, v long", ("A", 1), ("A ", 2), (" B", 5), ("B", 6))
    rows = append_aggregate(left, right, "k", ["v"]).orderBy("k").collect()
    assert [tuple(r) for r in rows] == [("A", "2"), ("B", "6")]  # the last of the groups in key order


def test_unique_is_not_trusted(spark):
    left = frame(spark, "k long", (1,), (2,))
    right = frame(spark, "k long, v string", (1, "a"), (1, "b"), (3, "c"))
    assert [tuple(r) for r in append_columns(left, right, "k", ["v"], unique=True).orderBy("k").collect()] == [(1, "b"), (2, "")]


@pytest.mark.parametrize("entries", [0, 100])
@pytest.mark.parametrize(
    "kind, values, mapping, expected",
    [
        ("long", [1, 2], {1.5: 9, 2.0: 8}, [1, 8]),
        ("long", [1], {1: 5, 1.5: 9, 1.0: 6}, [6]),
        ("double", [1.0, 2.5], {1: 9, 2.5: 8}, [9.0, 8.0]),
        ("decimal(10,2)", [Decimal("1.50"), Decimal("2.00")], {1.5: 9, 2: 8, 2.001: 7}, [9.0, 8.0]),
        ("tinyint", [1], {1: 2, 300: 4, 10**30: 5}, [2]),
    ],
)
def test_old_values_are_converted_exactly(spark, entries, kind, values, mapping, expected):
    long = mapping | {1000 + i: 7 for i in range(entries)}
    df = frame(spark, f"v {kind}", *[(v,) for v in values])
    assert [float(v) for v in column(map_values(df, "v", long), "v")] == expected


def test_values_a_type_cannot_hold():
    day, noon = datetime.date(2020, 1, 2), datetime.datetime(2020, 1, 2, 12)
    assert held_as(noon, T.DateType()) == [] and held_as(day, T.TimestampType()) == [datetime.datetime(2020, 1, 2)]
    assert held_as(2, T.BooleanType()) == [] and held_as(1.0, T.BooleanType()) == [True]
    assert held_as(float("nan"), T.DoubleType()) == [] and held_as("1", T.LongType()) == []
    assert held_as(2**53 + 1, T.DoubleType()) == [] and held_as(float("inf"), T.LongType()) == []


def test_sql_text_sees_updated_columns_in_any_case(spark):
    df = frame(spark, "id long, status string", (1, "O"))
    wanted = spec({"name": "status", "mapping": {"O": "Open"}, "transformation": "concat(lower(STATUS), '!')", "apply_to": "source"})
    assert column(reconcile(df, df, wanted).merged(), "source_status") == ["open!"]


@pytest.mark.parametrize("flags, numbers", [("source", "target"), ("target", "source")])
def test_flags_meet_numbers_as_keys(spark, flags, numbers):
    sides = {flags: frame(spark, "id boolean, v long", (True, 1), (False, 2)), numbers: frame(spark, "id int, v long", (1, 1), (0, 3))}
    found = counts(sides["source"], sides["target"], spec({"name": "v"}))
    assert (found["matched"], found["different"]) == (1, 1)


def test_statistics_of_many_fields(spark):
    names = [f"f{i}" for i in range(160)]
    schema = "id long, " + ", ".join(f"{n} long" for n in names)
    source = frame(spark, schema, (1, *range(160)))
    target = frame(spark, schema, (2, *range(160)))
    result = reconcile(source, target, spec(*({"name": n} for n in names)))
    rows = result.field_stats().collect()
    assert {r["field"] for r in rows} == set(names) and {r["comparable"] for r in rows} == {0}
    listed = result.statistics().first()["field_statistics"]
    assert [e["field"] for e in listed] == names
    same = reconcile(source, source, spec(*({"name": n} for n in names))).statistics().first()
    assert {e["matches"] for e in same["field_statistics"]} == {1} and same["matched"] == 1


def test_alternative_keys_read_the_table_twice_a_key(spark):
    target = frame(
        spark, "k long, k1 long, k2 long, j long, j1 long, v long", (1, 7, None, 5, 6, 1), (2, 1, 8, 5, 5, 2), (3, 9, 9, 5, None, 3)
    )
    source = frame(spark, "k long, j long, v long", (7, 5, 1), (8, 6, 2), (9, 5, 3))
    keys = [{"name": "k", "target_alternatives": ["k1", "k2"]}, {"name": "j", "target_alternatives": ["j1"]}]
    merged = reconcile(source, target, spec({"name": "v"}, keys=keys)).merged()
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") <= 7

    def expand(rows, key, alternatives):
        taken = {r[key] for r in rows}
        again = [r | {key: r[a]} for a in alternatives for r in rows if r[a] is None or r[a] not in taken]
        return rows + again

    names = target.columns
    rows = expand([dict(zip(names, r, strict=True)) for r in target.collect()], "k", ["k1", "k2"])
    rows = expand(rows, "j", ["j1"])
    mine = sorted((r["k"], r["j"], r["source_v"] is not None) for r in merged.filter("target_v is not null and k is not null and j is not null").collect())
    have = {(7, 5), (8, 6), (9, 5)}
    assert mine == sorted((r["k"], r["j"], (r["k"], r["j"]) in have) for r in rows if r["k"] is not None and r["j"] is not None)


def written(folder, **files):
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text, encoding="utf-8")
    return str(folder)


def test_long_rows_are_not_cut(spark, tmp_path):
    path = written(tmp_path, one='a,b\n1,2,3\n"x,y","say ""hi""",z,"u,v"\n7\n8,9\n')
    with pytest.raises(Exception, match="more cells than the header"):
        read_text_csv(spark, path, sep=",").collect()
    with pytest.raises(Exception, match="more cells than the header"):
        read_text_csv(spark, path, sep=",").select("a").collect()
    rows = {r["a"]: (r["b"], r["more"]) for r in read_text_csv(spark, path, sep=",", extra="more").collect()}
    assert rows == {"1": ("2", "3"), "x,y": ('say "hi"', 'z,"u,v"'), "7": ("", ""), "8": ("9", "")}


def test_other_headers_are_refused(spark, tmp_path):
    path = written(tmp_path, one="a,b\n1,2\n", two="b,a\n20,10\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_text_csv(spark, path, sep=",").collect()


def test_unreadable_cells_are_refused(spark, tmp_path):
    path = written(tmp_path, one="a,b\n1,x\n2,NULL\n")
    assert [tuple(r) for r in read_csv(spark, path, schema="a int, b string").collect()] == [(1, "x"), (2, None)]
    with pytest.raises(Exception, match="b is no int"):
        read_csv(spark, path, schema="a int, b int", unreadable="raise").collect()
    assert column(read_csv(spark, path, schema="a int, b int"), "b") == [None, None]
    assert [tuple(r) for r in unreadable_cells(spark, path, "a int, b int").collect()] == [("a", 0), ("b", 1)]
