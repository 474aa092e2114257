import pytest
from helpers import column, frame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions.predicates import FILTER_CONDITIONS, predicate
from tallymark.operators.filters import apply_filters, filter_counts
from tallymark.plans.spec import Filter


@pytest.fixture(scope="module")
def table(spark):
    return frame(
        spark, "id long, category string, value long, status string",
        (1, "A", 100, "Active"), (2, "B", 200, "Inactive"), (3, "A", 300, "Active"), (4, "C", 400, "Pending"),
        (5, "B", 500, "Active"),
    )


@pytest.mark.parametrize(
    "filters, ids",
    [
        ([Filter("category", "equals", "A")], [1, 3]),
        ([Filter("category", "not_equals", "A")], [2, 4, 5]),
        ([Filter("value", "greater_than", 300)], [4, 5]),
        ([Filter("category", "in_list", None, ("A", "C"))], [1, 3, 4]),
        ([Filter("category", "equals", "A"), Filter("value", "greater_than", 100)], [3]),
        ([Filter("nothing", "equals", "A")], []),
        ([Filter("value", "equals", "100.0")], [1]),
        ([Filter("value", "equals", "x")], []),
        ([Filter("value", "not_equals", "x")], [1, 2, 3, 4, 5]),
        ([Filter("value", "greater_than", "much")], []),
        ([Filter("value", "in", None, (100, "0300"))], [1]),
        ([Filter("value", "contains", "[24]0")], [2, 4]),
    ],
)
def test_filters(table, filters, ids):
    assert sorted(column(apply_filters(table, filters), "id")) == ids


NULLS = [("a.b",), ("axb",), ("",), (None,)]
EXPECTED = {  # per condition: verdicts for a.b, axb, empty, null with value "a"
    "equals": (False, False, False, False),
    "not_equals": (True, True, True, True),
    "starts_with": (True, True, False, False),
    "not_starts_with": (False, False, True, True),
    "ends_with": (False, False, False, False),
    "not_ends_with": (True, True, True, True),
    "contains": (True, True, False, False),
    "not_contains": (False, False, True, True),
    "regex_match": (True, True, False, False),
    "regex_not_match": (False, False, True, True),
    "less_than": (False, False, False, False),
    "less_than_equal": (False, False, False, False),
    "greater_than": (False, False, False, False),
    "greater_than_equal": (False, False, False, False),
    "in_list": (True, False, False, False),
    "not_in_list": (False, True, True, True),
    "in": (True, False, False, False),
    "not_in": (False, True, True, True),
    "is_null": (False, False, False, True),
    "is_not_null": (True, True, True, False),
}


@pytest.mark.parametrize("condition", FILTER_CONDITIONS)
def test_null_rows_get_a_verdict(spark, condition):
    df = frame(spark, "c string", *NULLS)
    got = df.select(predicate(F.col("c"), T.StringType(), condition, "a", ("a.b",)).alias("v"))
    assert tuple(column(got, "v")) == EXPECTED[condition]


def test_contains_is_a_pattern_and_regex_is_anchored(spark):
    df = frame(spark, "c string", ("a.b",), ("axb",), ("zaxb",))

    def verdicts(condition, value):
        return column(df.select(predicate(F.col("c"), T.StringType(), condition, value).alias("v")), "v")

    assert verdicts("contains", "a.b") == [True, True, True]
    assert verdicts("contains", r"a\.b") == [True, False, False]
    assert verdicts("regex_match", "a.b") == [True, True, False]
    assert verdicts("regex_match", "x|a") == [True, True, False]


def test_nan_is_missing(spark):
    df = frame(spark, "c double", (1.0,), (float("nan"),), (None,))

    def verdicts(condition, value=None):
        return column(df.select(predicate(F.col("c"), T.DoubleType(), condition, value).alias("v")), "v")

    assert verdicts("greater_than", 0) == [True, False, False]
    assert verdicts("not_equals", 5) == [True, True, True]
    assert verdicts("is_null") == [False, True, True]
    assert verdicts("starts_with", "1.0") == [True, False, False]


def test_text_numbers_and_flags(spark):
    df = frame(spark, "t string, b boolean", ("10", True), ("9", False), ("x", None))
    numbers = df.select(predicate(F.col("t"), T.StringType(), "greater_than", "9.5").alias("v"))
    flags = df.select(predicate(F.col("b"), T.BooleanType(), "equals", "True").alias("v"))
    as_number = df.select(predicate(F.col("b"), T.BooleanType(), "equals", 1).alias("v"))
    assert column(numbers, "v") == [True, False, False]
    assert column(flags, "v") == [True, False, False]
    assert column(as_number, "v") == [True, False, False]


def test_unknown_condition_and_empty_list_hold_for_nothing(spark):
    df = frame(spark, "c string", ("a",))
    for test in (
        predicate(F.col("c"), T.StringType(), "resembles", "a"),
        predicate(F.col("c"), T.StringType(), "in_list", None, ()),
        predicate(F.col("c"), T.StringType(), "not_in_list", None, None),
    ):
        assert column(df.select(test.alias("v")), "v") == [False]


def test_mapping_form_compares_numbers_as_text(spark):
    df = frame(spark, "c long", (7,), (8,))
    got = df.select(predicate(F.col("c"), T.LongType(), "equals", "7.0", numeric_equality=False).alias("v"))
    assert column(got, "v") == [False, False]


def test_counts(table):
    row = filter_counts(table, [Filter("status", "equals", "Active")]).first()
    assert tuple(row) == (5, 2, 3)


@pytest.mark.parametrize(
    "test, pushed",
    [
        (Filter("o_custkey", "equals", "7"), "EqualTo(o_custkey,7)"),
        (Filter("o_totalprice", "greater_than", 100), "GreaterThan(o_totalprice,100.0)"),
        (Filter("o_orderpriority", "starts_with", "1-"), "StringStartsWith(o_orderpriority,1-)"),
        (Filter("o_orderpriority", "not_starts_with", "1-"), "StringStartsWith(o_orderpriority,1-)"),
        (Filter("o_custkey", "in_list", None, ("1", "2")), "In(o_custkey, [1,2])"),
        (Filter("o_orderpriority", "contains", "LOW"), "StringContains(o_orderpriority,LOW)"),
        (Filter("o_orderpriority", "is_null"), "IsNull(o_orderpriority)"),
    ],
)
def test_filters_reach_the_scan(spark, test, pushed, capsys):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    apply_filters(orders, [test]).explain("formatted")
    plan = capsys.readouterr().out
    assert pushed in next(line for line in plan.splitlines() if line.startswith("PushedFilters"))
