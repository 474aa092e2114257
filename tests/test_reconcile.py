"""Scenarios of small tables with known outcomes."""

import datetime

import pytest
from helpers import column, counts, frame, spec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions import recipes
from tallymark.functions.compare import field_match, text_differs
from tallymark.operators.mapping import ColumnUpdates, map_values, python_transformation
from tallymark.plans import reports
from tallymark.plans.reconcile import Skew, reconcile
from tallymark.plans.spec import SpecError

STATUS = {"Active": "A", "Inactive": "I"}


def transform_values(df, name, expression):
    columns = ColumnUpdates(df)
    columns.transform(name, expression)
    return columns.settle()


def outcome(result: dict) -> tuple:
    return tuple(result[k] for k in ("matched", "different", "missing_in_target", "missing_in_source"))


def test_basic_pair(spark):
    source = frame(
        spark, "id long, amount double, status string, date string",
        (1, 100.0, "Active", " 2023-01-01 "), (2, 200.0, "Inactive", "2023-01-02 "),
        (3, 300.0, "Active", " 2023-01-03"), (4, 400.0, "Inactive", "2023-01-04"),
    )
    target = frame(
        spark, "id long, amount double, status string, date string",
        (1, 100.0, "A", "2023-01-01"), (2, 200.01, "I", "2023-01-02"), (3, 299.99, "A", "2023-01-03"),
        (5, 500.0, "A", "2023-01-05"),
    )
    wanted = spec(
        {"name": "amount", "tolerance": 0.01},
        {"name": "status", "mapping": STATUS},
        {"name": "date", "transformation": recipes.strip},
    )
    got = counts(source, target, wanted)
    assert outcome(got) == (3, 0, 1, 1)
    assert (got["total_source"], got["total_target"], got["match_rate"], got["difference_rate"]) == (4, 4, 1.0, 0.0)


def test_differences_and_percentages(spark):
    source = frame(spark, "id long, amount double, status string", (1, 100.0, "A"), (2, 200.0, "I"), (3, 300.0, "A"))
    target = frame(spark, "id long, amount double, status string", (1, 100.5, "A"), (2, 250.0, "A"), (3, 300.0, "A"))
    assert outcome(counts(source, target, spec({"name": "amount", "tolerance": 1.0}, {"name": "status"}))) == (2, 1, 0, 0)

    source = frame(spark, "id long, amount double", (1, 100.0), (2, 200.0), (3, 1000.0))
    target = frame(spark, "id long, amount double", (1, 101.0), (2, 204.0), (3, 1050.0))
    assert outcome(counts(source, target, spec({"name": "amount", "tolerance": "3%"}))) == (2, 1, 0, 0)


def test_missing_field_makes_rows_different(spark):
    source = frame(spark, "id long, extra string", (1, "a"), (2, "b"), (3, None))
    target = frame(spark, "id long", (1,), (2,), (3,))
    assert outcome(counts(source, target, spec({"name": "extra"}))) == (1, 2, 0, 0)


@pytest.mark.parametrize(
    "tolerance, pairs, expected",
    [
        (0.01, [(100.0, 100.01), (200.0, 199.99), (300.0, 301.0)], [True, True, False]),
        (1.0, [(100.0, 100.01), (200.0, 199.99), (300.0, 301.0)], [True, True, True]),
        ("1%", [(100.0, 101.0), (200.0, 198.0), (0.0, 0.0)], [True, True, True]),
        ("0.5%", [(100.0, 101.0), (200.0, 198.0), (0.0, 0.0)], [False, False, True]),
        ("1%", [(0.0, 0.001), (0.0, None), (None, 0.0)], [False, False, False]),
        (0.01, [(100.0, 100.01), (None, None), (300.0, None)], [True, True, False]),
        (0.01, [(float("inf"), float("inf")), (float("inf"), 1.0), (float("nan"), None)], [True, False, True]),
        ("1%", [(float("inf"), float("inf")), (1.0, float("inf"))], [False, False]),
        (None, [(1.0, 1.0), (None, None), (1.0, None), (float("nan"), None)], [True, True, False, True]),
    ],
)
def test_number_matches(spark, tolerance, pairs, expected):
    df = frame(spark, "s double, t double", *pairs)
    double = T.DoubleType()
    assert column(df.select(field_match(F.col("s"), double, F.col("t"), double, tolerance).alias("m")), "m") == expected


def test_families(spark):
    df = frame(spark, "s string, l long, d double, b boolean", ("100", 100, 100.0, True), (None, None, None, None))
    types = {f.name: f.dataType for f in df.schema.fields}

    def verdict(a, b, tolerance=None):
        return column(df.select(field_match(F.col(a), types[a], F.col(b), types[b], tolerance).alias("m")), "m")

    assert verdict("s", "l") == [False, True]
    assert verdict("l", "d") == [True, True]
    assert verdict("s", "l", 0.0) == [True, True]
    assert verdict("b", "l") == [False, True]


def test_dates_against_timestamps(spark):
    df = spark.sql(
        "select date'2024-01-02' as d, timestamp_ntz'2024-01-02 00:00:00' as t, timestamp_ntz'2024-01-02 00:00:01' as u"
    )
    types = {f.name: f.dataType for f in df.schema.fields}
    assert df.select(field_match(F.col("d"), types["d"], F.col("t"), types["t"])).first()[0] is True
    assert df.select(field_match(F.col("d"), types["d"], F.col("u"), types["u"])).first()[0] is False


def test_display_difference(spark):
    cases = [
        (None, None, False), ("", "", False), ("  ", "  ", False), (None, "", True), ("value", None, True),
        ("value", "", True), ("value", "value ", False), ("value1", "value2", True), ("0", None, True), ("0", "", True),
    ]
    df = frame(spark, "s string, t string", *[c[:2] for c in cases])
    text = T.StringType()
    got = column(df.select(text_differs(F.col("s"), text, F.col("t"), text).alias("x")), "x")
    assert got == [c[2] for c in cases]
    zero = spark.range(1).select(text_differs(F.lit("0"), text, F.lit(0), T.IntegerType())).first()[0]
    assert zero is False


def test_field_statistics_with_nulls(spark):
    source = frame(spark, "id long, v string", (1, "A"), (2, None), (3, None), (4, "D"))
    target = frame(spark, "id long, v string", (1, "A"), (2, "B"), (3, None), (5, None))
    row = reconcile(source, target, spec({"name": "v"})).field_stats().first()
    assert (row["matches"], row["comparable"], row["differences"], row["match_rate"]) == (1, 2, 1, 0.5)


def test_one_sided_nulls_are_comparable(spark):
    source = frame(spark, "id long, v string", (1, None), (2, None))
    target = frame(spark, "id long, v string", (1, "2024-01-01"), (2, "2024-01-02"))
    row = reconcile(source, target, spec({"name": "v"})).field_stats().first()
    assert (row["matches"], row["comparable"], row["match_rate"]) == (0, 2, 0.0)


def test_ignored_fields_are_kept_but_not_compared(spark):
    source = frame(spark, "id long, a double, note string", (1, 1.0, "x"), (2, 2.0, "y"))
    target = frame(spark, "id long, a double, note string", (1, 1.0, "p"), (2, 2.0, "q"))
    result = reconcile(source, target, spec({"name": "a"}, {"name": "note", "ignore": True}))
    assert outcome(result.summary().first().asDict()) == (2, 0, 0, 0)
    assert column(result.field_stats(), "field") == ["a"]
    shown = reports.matched_report(result)
    assert shown.columns == ["id", "Source: a", "Target: a", "Source: note (ignored)", "Target: note (ignored)"]


def test_only_ignored_fields_means_all_match(spark):
    source = frame(spark, "id long, note string", (1, "x"), (2, "y"))
    target = frame(spark, "id long, note string", (1, "p"), (3, "q"))
    result = reconcile(source, target, spec({"name": "note", "ignore": True}))
    assert outcome(result.summary().first().asDict()) == (1, 0, 1, 1)
    assert result.field_stats().count() == 0
    assert result.breaks().count() == 0


def test_mapping(spark):
    df = frame(spark, "status string", ("Active",), ("Inactive",), ("Active",), ("Unknown",), (None,))
    assert column(map_values(df, "status", STATUS), "status") == ["A", "I", "A", "Unknown", None]
    assert column(map_values(df, "status", {"Active": None}), "status")[0] == "Active"
    assert column(map_values(df, "status", {1: "x"}), "status")[0] == "Active"


def test_mapping_result_types(spark):
    flags = frame(spark, "v string", ("Yes",), ("No",), ("maybe",))
    assert column(map_values(flags, "v", {"Yes": True, "No": False}), "v") == ["True", "False", "maybe"]
    numbers = frame(spark, "v long", (1,), (2,))
    assert column(map_values(numbers, "v", {1: 1.5}), "v") == [1.5, 2.0]
    assert column(map_values(numbers, "v", {1: "one"}), "v") == ["one", "2"]


def test_long_mapping_equals_short_mapping(spark):
    df = frame(spark, "v long", (1,), (99,), (500,), (None,))
    mapping = {i: f"n{i}" for i in range(100)}
    assert sorted(column(map_values(df, "v", mapping), "v"), key=str) == ["500", None, "n1", "n99"]


def test_transformation_skips_nulls_and_runs_after_mapping(spark):
    df = frame(spark, "date string", (" 2023-01-01 ",), (None,), ("2023-01-03 ",))
    assert column(transform_values(df, "date", recipes.strip), "date") == ["2023-01-01", None, "2023-01-03"]
    source = frame(spark, "id long, status string", (1, "Active"), (2, "Inactive"))
    result = reconcile(source, source, spec({"name": "status", "mapping": STATUS, "transformation": "lower(status)"}))
    assert sorted(column(result.prepared("source"), "status")) == ["a", "i"]


def test_python_transformation(spark):
    df = frame(spark, "v string", ("abc",), (None,))
    assert column(transform_values(df, "v", python_transformation(lambda x: x[::-1], "string")), "v") == ["cba", None]


def test_bad_expression_raises(spark):
    df = frame(spark, "id long, v string", (1, "a"))
    with pytest.raises(Exception, match="no_such_column"):
        reconcile(df, df, spec({"name": "v", "transformation": "upper(no_such_column)"}))


def test_keyed_conditional_mapping(spark):
    source = frame(
        spark, "id long, type string, status string",
        (1, "EQUITY", "N"), (2, "EQUITY", "F"), (3, "BOND", "N"), (4, "BOND", "C"),
    )
    target = frame(
        spark, "id long, type string, status string",
        (1, "EQUITY", "New"), (2, "EQUITY", "Filled"), (3, "BOND", "New Order"), (4, "BOND", "Complete"),
    )
    full = {"EQUITY": {"N": "New", "F": "Filled"}, "BOND": {"N": "New Order", "C": "Complete"}}
    fields = [{"name": "type"}, {"name": "status", "conditional_mapping": {"condition_field": "type", "mappings": full}}]
    assert outcome(counts(source, target, spec(*fields))) == (4, 0, 0, 0)
    half = {"EQUITY": full["EQUITY"]}
    fields[1] = {"name": "status", "conditional_mapping": {"condition_field": "type", "mappings": half}}
    assert outcome(counts(source, target, spec(*fields))) == (2, 2, 0, 0)


def test_absent_condition_field_changes_nothing(spark):
    df = frame(spark, "id long, status string", (1, "N"))
    mapping = {"condition_field": "nowhere", "mappings": {"X": {"N": "New"}}}
    assert outcome(counts(df, df, spec({"name": "status", "conditional_mapping": mapping}))) == (1, 0, 0, 0)


# condition, source rows (condition column value, status) and the status each should become
RAW_CASES = [
    ("not_starts_with", "ABC", None, "string", [("ABC1", "KRA", "KRA"), ("XYZ", "KRA", "KRW"), (None, "KRA", "KRW")]),
    ("starts_with", "US", None, "string", [("US1", "KRA", "KRW"), ("EU1", "KRA", "KRA"), ("US2", "USD", "USD")]),
    ("greater_than", "1000", None, "double", [(1500.0, "KRA", "KRW"), (500.0, "KRA", "KRA"), (None, "KRA", "KRA")]),
    ("in_list", None, ["A", "B"], "string", [("A", "KRA", "KRW"), ("C", "KRA", "KRA"), ("B", "KRA", "KRW")]),
    ("is_null", None, None, "string", [(None, "KRA", "KRW"), ("x", "KRA", "KRA"), (None, "USD", "USD")]),
    ("regex_match", "^T[0-9]+$", None, "string", [("T12", "KRA", "KRW"), ("TX", "KRA", "KRA"), ("T1", "KRA", "KRW")]),
    ("less_than", "many", None, "double", [(1.0, "KRA", "KRA"), (2.0, "KRA", "KRA"), (3.0, "KRA", "KRA")]),
]


@pytest.mark.parametrize("kind, value, values, dtype, rows", RAW_CASES)
def test_condition_on_an_unconfigured_column(spark, kind, value, values, dtype, rows):
    """The condition column is neither key nor field; it comes from the raw table."""
    source = frame(spark, f"id long, cond {dtype}, status string", *[(i, c, s) for i, (c, s, _) in enumerate(rows)])
    target = frame(spark, "id long, status string", *[(i, e) for i, (_, _, e) in enumerate(rows)])
    mapping = {"condition_field": "cond", "condition_type": kind, "mappings": {"default": {"KRA": "KRW"}}}
    if value:
        mapping["condition_value"] = value
    if values:
        mapping["condition_list"] = values
    mapping["apply_to"] = "source"
    assert outcome(counts(source, target, spec({"name": "status", "conditional_mapping": mapping}))) == (3, 0, 0, 0)


DEMO = "trade_id,account_id,asset_class,status,market_code,currency,instruction,price"
DEMO_SOURCE = [
    (1, "ACC001", "EQ", "N", "US", "USD", "DVP", 100.5), (2, "ACC002", "EQ", "F", "EU", "EUR", "FOP", 250.75),
    (3, "ACC003", "FI", "N", "US", "USD", "DVP", 1000.0), (4, "ACC004", "FI", "F", "ASIA", "JPY", "REPO", 500.25),
    (5, "ACC005", "DV", "PF", "EU", "EUR", "CASH", 75.0), (6, "ACC006", "EQ", "C", "US", "USD", "HOLD", 150.0),
]
DEMO_TARGET = [
    (1, "ACC001", "EQ", "New", "US", "US Dollar", "Delivery vs Payment", 100.5),
    (2, "ACC002", "EQ", "Filled", "EU", "European Euro", "Free of Payment", 250.75),
    (3, "ACC003", "FI", "New Order", "US", "US Dollar", "Bond Settlement DVP", 1000.0),
    (4, "ACC004", "FI", "Complete", "ASIA", "Japanese Yen", "Repurchase Agreement", 500.25),
    (5, "ACC005", "DV", "Executing", "EU", "European Euro", "Cash Settlement", 75.0),
    (6, "ACC006", "EQ", "Cancelled", "US", "US Dollar", "Hold in Account", 150.0),
]


def test_demo_trades(spark):
    schema = ", ".join(f"{c} {'long' if c == 'trade_id' else 'double' if c == 'price' else 'string'}"
                       for c in DEMO.split(","))

    def when_equals(field, value, mapping):
        return {"condition_field": field, "condition_type": "equals", "condition_value": value,
                "mappings": {"default": mapping}}

    fields = [
        {"name": "asset_class"}, {"name": "market_code"}, {"name": "price", "tolerance": "0.1%"},
        {"name": "status", "conditional_mapping": when_equals(
            "asset_class", "EQ", {"N": "New", "F": "Filled", "PF": "Partially Filled", "C": "Cancelled"})},
        {"name": "currency", "conditional_mapping": when_equals("market_code", "US", {"USD": "US Dollar"})},
        {"name": "instruction", "conditional_mapping": when_equals(
            "asset_class", "FI", {"DVP": "Bond Settlement DVP", "REPO": "Repurchase Agreement"})},
    ]
    keys = ["trade_id", "account_id"]
    result = reconcile(frame(spark, schema, *DEMO_SOURCE), frame(spark, schema, *DEMO_TARGET), spec(*fields, keys=keys))
    assert outcome(result.summary().first().asDict()) == (0, 6, 0, 0)
    matches = {r["field"]: (r["matches"], r["comparable"]) for r in result.field_stats().collect()}
    assert matches == {
        "asset_class": (6, 6), "market_code": (6, 6), "price": (6, 6), "status": (3, 6), "currency": (3, 6),
        "instruction": (2, 6),
    }


def test_null_keys_join_and_duplicates_multiply(spark):
    source = frame(spark, "id long, v string", (None, "a"), (1, "x"), (1, "y"))
    target = frame(spark, "id long, v string", (None, "a"), (1, "x"), (1, "x"), (1, "z"))
    assert outcome(counts(source, target, spec({"name": "v"}))) == (3, 4, 0, 0)
    assert outcome(counts(source, target, spec({"name": "v"}), null_keys="differ")) == (2, 4, 1, 1)
    with pytest.raises(ValueError, match="duplicate"):
        reconcile(source, target, spec({"name": "v"}), on_duplicate="error")


def test_key_checks(spark):
    source = frame(spark, "id long, v string", (1, "a"))
    with pytest.raises(ValueError, match="missing reconciliation keys in target"):
        reconcile(source, frame(spark, "key long, v string", (1, "a")), spec({"name": "v"}))
    with pytest.raises(ValueError, match="key 'id'"):
        reconcile(source, frame(spark, "id string, v string", ("1", "a")), spec({"name": "v"}))
    mixed = frame(spark, "id int, v string", (1, "a"))
    assert outcome(counts(source, mixed, spec({"name": "v"}))) == (1, 0, 0, 0)


def test_padded_column_names(spark):
    source = frame(spark, "` id ` long, `v  ` string", (1, "a"))
    assert outcome(counts(source, frame(spark, "id long, v string", (1, "a")), spec({"name": "v"}))) == (1, 0, 0, 0)


def test_alternative_keys(spark):
    """An alternative value that is a primary key is not used; two alternatives do not exclude each other."""
    source = frame(spark, "id long, v string", (1, "a"), (2, "b"), (7, "c"), (8, "c"))
    target = frame(
        spark, "id long, far long, other long, v string",
        (1, 2, None, "a"), (2, None, 7, "b"), (3, 7, 8, "c"), (4, None, None, "d"),
    )
    wanted = spec({"name": "v"}, keys=[{"name": "id", "target_alternatives": ["far", "other"]}])
    got = counts(source, target, wanted, drop_null_alternatives=True)
    # appended: far -> (7, c); other -> (7, b), (8, c)
    assert (got["total_target"], outcome(got)) == (7, (4, 1, 0, 2))
    got = counts(source, target, wanted)
    assert (got["total_target"], outcome(got)) == (11, (4, 1, 0, 6))


def test_post_join_steps_and_audit(spark):
    source = frame(spark, "id long, a double, b string", (1, 1.0, "1,000"), (2, 2.0, "x"), (3, 3.0, None))
    target = frame(spark, "id long, a double, b string", (1, 5.0, "1000"), (2, 2.0, "y"), (4, 4.0, None))
    fields = [
        {"name": "a", "post_merge_source_calculation": "if(target_a = 5, target_a, source_a)",
         "post_merge_comment": "five wins"},
        {"name": "b", "post_merge_source_calculation": lambda df: F.coalesce(df["target_b"], df["source_b"])},
    ]
    result = reconcile(source, target, spec(*fields))
    assert outcome(result.summary().first().asDict()) == (2, 0, 1, 1)
    rows = {tuple(r) for r in result.adjustments().collect()}
    assert rows == {
        (1, "matched", "source", "a", "1.0", "5.0", "five wins"),
        (2, "matched", "source", "b", "x", "y", "Post-merge source calculation applied"),
    }


def test_force_zero_needs_its_columns(spark):
    df = frame(spark, "id long, m double", (1, 1.0))
    wanted = spec({"name": "m", "force_zero_when_settled": True})
    assert reconcile(df, df, wanted).adjustments().count() == 0


def test_change_audit_rows(spark):
    source = frame(spark, "id long, s string", (1, "Active"), (2, "A"), (3, None), (4, "Other"))
    result = reconcile(source, source, spec({"name": "s", "mapping": STATUS, "apply_to": "source"}))
    assert [tuple(r) for r in result.changes().collect()] == [
        (1, "source", "s", "mapping", "Active", "A", "Active -> A")
    ]
    assert tuple(result.change_counts().first()) == ("source", "s", "mapping", 1, 3, 2)


def test_missing_reports_show_raw_values_and_hide_hidden_fields(spark):
    source = frame(spark, "id long, s string, secret string", (1, "Active", "x"), (2, "Active", "y"))
    target = frame(spark, "id long, s string, secret string", (2, "A", "y"), (3, "Inactive", "z"))
    fields = [{"name": "s", "mapping": STATUS}, {"name": "secret", "hidden": True}]
    result = reconcile(source, target, spec(*fields))
    assert [r.asDict() for r in reports.missing_in_target_report(result).collect()] == [{"id": 1, "s": "Active"}]
    assert [r.asDict() for r in reports.missing_in_source_report(result).collect()] == [{"id": 3, "s": "Inactive"}]
    assert reports.matched_report(result).columns == ["id", "Source: s", "Target: s"]


def test_empty_categories_keep_their_schema(spark):
    df = frame(spark, "id long, v string", (1, "a"))
    result = reconcile(df, df, spec({"name": "v"}))
    assert reports.different_report(result).columns == ["id", "Source: v", "Target: v", "diff_fields"]
    assert reports.different_report(result).count() == 0
    assert reports.missing_in_source_report(result).count() == 0


def test_summary_report_lists_filters_and_source_order(spark):
    df = frame(spark, "b string, a string, id long", ("x", "y", 1))
    wanted = spec(
        {"name": "a"}, {"name": "b"},
        source=[{"field": "a", "condition": "in_list", "values": ["y"]}], target=[{"field": "b", "condition": "is_not_null"}],
    )
    rows = {r["label"]: r["value"] for r in reports.summary_report(reconcile(df, df, wanted)).collect()}
    assert rows["Configured Fields"] == "b, a"
    assert rows["Data Filters"] == "Source: a in_list ['y']\nTarget: b is_not_null"
    assert (rows["Matched Records"], rows["Source File"]) == ("1", "N/A")


def test_diff_columns(spark):
    source = frame(spark, "id long, v double", (1, 110.0), (2, 0.0), (3, 5.0), (4, None))
    target = frame(spark, "id long, v double", (1, -100.0), (2, 0.0), (3, 0.0), (4, 1.0))
    wanted = spec({"name": "v", "diff_amount": True, "diff_percent": True, "tolerance": 1000.0})
    shown = reports.matched_report(reconcile(source, target, wanted)).orderBy("id")
    rows = [(r["Diff Amount: v"], r["Diff %: v"]) for r in shown.collect()]
    assert rows == [(210.0, 210.0), (0.0, 0.0), (5.0, None)]


def test_wide_statistics_equal_narrow_ones(spark, monkeypatch):
    source = frame(spark, "id long, a string, b double", (1, "x", 1.0), (2, None, 2.0), (3, "z", None))
    target = frame(spark, "id long, a string, b double", (1, "x", 1.5), (2, "y", 2.0), (3, "z", None))
    result = reconcile(source, target, spec({"name": "a"}, {"name": "b", "tolerance": 0.1}))
    narrow = sorted(map(tuple, result.field_stats().collect()))
    monkeypatch.setattr("tallymark.plans.reconcile.WIDE_FIELDS", 1)
    assert sorted(map(tuple, result.field_stats().collect())) == narrow


def test_options_are_checked(spark):
    df = frame(spark, "id long, v string", (1, "a"))
    for options in ({"skew": "perhaps"}, {"on_duplicate": "drop"}):
        with pytest.raises(ValueError):
            reconcile(df, df, spec({"name": "v"}), **options)
    with pytest.raises(SpecError):
        reconcile(df, df, {})


def test_rows_without_a_partner_by_anti_join(spark):
    schema = "a long, b string, c date, v double"
    day = datetime.date(2024, 1, 1)
    source = frame(spark, schema, (0, "", None, 1.0), (None, "", None, 2.0), (None, None, day, 3.0), (1, "x", day, 4.0))
    target = frame(spark, schema, (None, "", None, 5.0), (1, "x", day, 6.0), (1, "x", day, 7.0), (0, None, None, 8.0))
    for null_keys in ("match", "differ"):
        result = reconcile(source, target, spec({"name": "v"}, keys=["a", "b", "c"]), null_keys=null_keys)
        for rows, category, side in (
            (result.missing_in_target(), "missing_in_target", "source_v"),
            (result.missing_in_source(), "missing_in_source", "target_v"),
        ):
            assert sorted(column(rows, side)) == sorted(column(result.records(category), side))


def test_wide_specs_stay_few_projections(spark):
    """Every field is mapped and transformed; plans stay shallow and quick to build."""
    names = [f"f{i:03d}" for i in range(200)]
    df = spark.range(3).select(F.col("id"), *[F.concat(F.lit("v"), F.col("id")).alias(n) for n in names])
    fields = [{"name": n, "mapping": {"v1": "one"}, "transformation": recipes.upper_trimmed} for n in names]
    result = reconcile(df, df, spec(*fields))
    plan = result.prepared("source")._jdf.queryExecution().logical().toString()
    assert plan.count("Project") <= 8
    assert column(result.prepared("source").orderBy("id"), "f199") == ["V0", "ONE", "V2"]


def test_sql_text_sees_the_mapped_value(spark):
    df = frame(spark, "id long, a string, ab string", (1, "x", "y"))
    fields = [
        {"name": "a", "mapping": {"x": "mapped"}, "transformation": "concat(a, '!')"},
        {"name": "ab", "transformation": "concat(ab, a)"},
    ]
    row = reconcile(df, df, spec(*fields)).prepared("source").first()
    assert (row["a"], row["ab"]) == ("mapped!", "ymapped!")


def test_declared_type_after_mapping_and_transformation(spark):
    source = frame(spark, "id long, flag string, amount string", (1, "Yes", "$1,000"), (2, "perhaps", "x"))
    target = frame(spark, "id long, flag boolean, amount double", (1, True, 1000.0), (2, None, None))
    fields = [
        {"name": "flag", "mapping": recipes.FLAG_TEXTS, "type": "boolean"},
        {"name": "amount", "transformation": recipes.currency_amount, "type": "double"},
    ]
    result = reconcile(source, target, spec(*fields))
    assert outcome(result.summary().first().asDict()) == (2, 0, 0, 0)
    changes = {(r["field"], r["kind"], r["original"], r["new"]) for r in result.changes().collect()}
    assert changes == {("flag", "mapping", "Yes", "True"), ("amount", "transformation", "$1,000", "1000.0")}


@pytest.mark.parametrize("options", [{}, {"skew": Skew("always", share=0.2, min_rows=1)}])
def test_awkward_column_names(spark, options):
    source = frame(spark, "`Deal Num` long, `a.b` string, `%` double", (1, "x", 1.0), (1, "x", 1.0), (2, "y", None))
    target = frame(spark, "`Deal.Num` int, `a.b` string, `%` double", (1, "X", 1.0), (3, "z", 2.0))
    fields = [
        {"name": "a.b", "mapping": {**{f"n{i}": "n" for i in range(80)}, "x": "X"}, "apply_to": "source"},
        {"name": "%", "tolerance": "1%", "diff_percent": True},
    ]
    keys = [{"name": "id.key", "source": "Deal Num", "target": "Deal.Num"}]
    result = reconcile(source, target, spec(*fields, keys=keys), **options)
    assert outcome(result.summary().first().asDict()) == (2, 0, 1, 1)
    assert result.duplicate_keys().count() == 1
    assert result.missing_in_target().count() == 1
    assert sorted(r["field"] for r in result.field_stats().collect()) == ["%", "a.b"]
    assert result.changes().count() == 2 and result.joined_changes().count() == 2
    assert reports.matched_report(result).columns[:3] == ["id.key", "Source: a.b", "Target: a.b"]
    assert reports.missing_in_target_report(result).first()["a.b"] == "y"
