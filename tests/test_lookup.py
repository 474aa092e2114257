import pytest
from helpers import column, frame

from tallymark.operators.lookup import (
    aggregate_by,
    append_aggregate,
    append_columns,
    parse_key_pairs,
    repeated_keys,
    resolve_column,
)


def test_key_pairs():
    assert parse_key_pairs("a, b=c,") == [("a", "a"), ("b", "c")]
    assert parse_key_pairs(["a", "b = c", ("d", "e")]) == [("a", "a"), ("b", "c"), ("d", "e")]
    with pytest.raises(ValueError):
        parse_key_pairs(" ,")


def test_columns_resolve_without_case(spark):
    df = frame(spark, "` Deal Num ` long, x long", (1, 2))
    assert resolve_column(df, "x") == "x"
    assert resolve_column(df, "deal num") == " Deal Num "
    with pytest.raises(ValueError, match="missing column 'y'"):
        resolve_column(df, "y")


def test_append(spark):
    left = frame(spark, "k string, amount string", (" a ", "1.50"), ("b", "2.00"), ("", "3"), (None, "4"), ("z", "5"))
    right = frame(
        spark, "key string, MTM double, n long",
        ("a", 1.0, 1), ("a ", 2.5, 2), ("b", None, 1), ("  ", 9.0, 1), (None, 8.0, 1),
    )
    got = append_columns(left, right, "k=KEY", ["mtm"], order_by="n")
    assert got.columns == ["k", "amount", "mtm"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == [
        (" a ", "1.50", "2.5"), ("b", "2.00", ""), ("", "3", ""), (None, "4", ""), ("z", "5", ""),
    ]
    assert tuple(repeated_keys(right, ["key"]).first()) == (3, 2, 1)


def test_append_checks(spark):
    left, right = frame(spark, "k string, mtm string", ("a", "1")), frame(spark, "k string, MTM long", ("a", 1))
    with pytest.raises(ValueError, match="already has columns"):
        append_columns(left, right, "k", ["MTM"], unique=True)
    with pytest.raises(ValueError, match="output names"):
        append_columns(left, right, "k", ["MTM"], ["a", "b"], unique=True)
    with pytest.raises(ValueError, match="order_by"):
        append_columns(left, right, "k", ["MTM"], ["a"])


def test_integer_keys_join_natively(spark):
    right = frame(spark, "k int, v string", (1, "x"), (None, "y"), *[(i, "z") for i in range(2, 5000)])
    for dtype in ("long", "tinyint"):
        left = frame(spark, f"k {dtype}", (1,), (-2,), (None,), (None,))
        assert sorted(column(append_columns(left, right, "k", ["v"], unique=True), "v")) == ["", "", "", "x"]


VALUES = [("a", 2.0, 1), ("a", None, 2), ("a", 5.0, 3), ("b", None, 1), (None, 7.0, 1)]


@pytest.mark.parametrize(
    "function, expected",
    [
        ("sum", {"a": 7.0, "b": 0.0}), ("mean", {"a": 3.5, "b": None}), ("min", {"a": 2.0, "b": None}),
        ("max", {"a": 5.0, "b": None}), ("first", {"a": 2.0, "b": None}), ("last", {"a": 5.0, "b": None}),
    ],
)
def test_aggregates(spark, function, expected):
    df = frame(spark, "k string, v double, n long", *VALUES)
    got = aggregate_by(df, ["k"], ["v"], function, order_by="n")
    assert {r["k"]: r["v"] for r in got.collect()} == expected


def test_aggregate_checks(spark):
    df = frame(spark, "k string, v double, n long", *VALUES)
    with pytest.raises(ValueError, match="columns not found"):
        aggregate_by(df, ["k", "x"], ["v"])
    with pytest.raises(ValueError, match="order_by"):
        aggregate_by(df, ["k"], ["v"], "last")
    with pytest.raises(ValueError, match="function"):
        aggregate_by(df, ["k"], ["v"], "median")


def test_append_aggregate(spark):
    left = frame(spark, "id string", ("a",), ("b",), ("c",))
    df = frame(spark, "k string, v double, n long", *VALUES)
    got = append_aggregate(left, df, "id=k", ["v"], ["total"])
    assert {r["id"]: r["total"] for r in got.collect()} == {"a": "7.0", "b": "0.0", "c": ""}
