import datetime

import pytest
from helpers import frame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions import values as V

NUMBERS = {
    "1e5": 100000.0, " 12 ": 12.0, "+3": 3.0, "-.5": -0.5, "1.": 1.0, "inf": float("inf"), "Infinity": float("inf"),
    "1,000": None, "1.0d": None, "5f": None, "0x10": None, "True": None, "1_000": None, "abc": None, "": None,
    "NaN": None, "-inf": float("-inf"), "1e400": float("inf"),
}
TEXTS = {
    1.0: "1.0", 1e7: "10000000.0", 1e16: "1e+16", 1e-5: "1e-05", 0.0001: "0.0001", 123456.78: "123456.78",
    -0.25: "-0.25", 12345678.125: "12345678.125", 1.5e-7: "1.5e-07", 2.5e20: "2.5e+20", 1e100: "1e+100",
    9999999999999998.0: "9999999999999998.0", 0.0: "0.0", float("inf"): "inf", float("-inf"): "-inf",
}


def test_text_to_number(spark):
    df = frame(spark, "t string", *[(t,) for t in NUMBERS], (None,))
    got = {r["t"]: r["n"] for r in df.select("t", V.as_number(F.col("t"), T.StringType()).alias("n")).collect()}
    assert got == {**NUMBERS, None: None}


def test_double_to_text(spark):
    df = frame(spark, "d double", *[(d,) for d in TEXTS])
    got = {r["d"]: r["s"] for r in df.select("d", V.as_text(F.col("d"), T.DoubleType()).alias("s")).collect()}
    assert got == TEXTS
    assert all(str(d) == s for d, s in TEXTS.items())


def test_other_texts(spark):
    row = spark.range(1).select(
        V.as_text(F.lit(True), T.BooleanType()).alias("t"),
        V.as_text(F.lit(False), T.BooleanType()).alias("f"),
        V.as_text(F.lit(None).cast("boolean"), T.BooleanType()).alias("n"),
        V.as_text(F.lit(7), T.IntegerType()).alias("i"),
        V.as_text(F.lit("2024-01-02").cast("date"), T.DateType()).alias("d"),
        V.as_text(F.lit("2024-01-02 03:04:05").cast("timestamp_ntz"), T.TimestampNTZType()).alias("ts"),
        V.as_text(F.lit("2024-01-02 03:04:05.5").cast("timestamp_ntz"), T.TimestampNTZType()).alias("us"),
        V.as_text(F.lit(float("nan")), T.DoubleType()).alias("nan"),
    ).first()
    assert tuple(row) == (
        "True", "False", None, "7", "2024-01-02", "2024-01-02 03:04:05", "2024-01-02 03:04:05.500000", None,
    )


def test_date_and_flag_as_number(spark):
    row = spark.range(1).select(
        V.as_number(F.lit("1970-01-02").cast("date"), T.DateType()).alias("d"),
        V.as_number(F.lit(True), T.BooleanType()).alias("b"),
        V.as_number(F.lit(float("nan")), T.DoubleType()).alias("nan"),
    ).first()
    assert tuple(row) == (86_400e9, 1.0, None)


@pytest.mark.parametrize(
    "text, expected",
    [
        ("31/12/24", datetime.date(2024, 12, 31)),
        ("1/2/68", datetime.date(2068, 2, 1)),
        ("01/02/69", datetime.date(1969, 2, 1)),
        ("29/2/96", datetime.date(1996, 2, 29)),
        ("31/02/24", None),
        ("2024-12-31", None),
        ("31/12/2024", None),
        ("", None),
    ],
)
def test_two_digit_years(spark, text, expected):
    assert spark.range(1).select(V.day_month_year(F.lit(text), T.StringType())).first()[0] == expected


@pytest.mark.parametrize("value, expected", [(2.00005, 2.0), (-0.12345, -0.1234), (1.23456, 1.2346), (0.0, 0.0)])
def test_rounding_to_four(spark, value, expected):
    assert spark.range(1).select(V.round_half_even(F.lit(value), 4)).first()[0] == expected


def test_nested_types_are_refused():
    with pytest.raises(TypeError):
        V.family(T.ArrayType(T.LongType()))
