"""Value families, text rendering and number parsing.

Every helper returns a Column, so the work stays in generated code. A "clean"
column is one whose floating NaNs have been turned into NULL.
"""

from __future__ import annotations

import math
import re
from datetime import date, datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT = "text"
NUMBER = "number"
DATETIME = "datetime"
EMPTY = "empty"

# Number texts that are accepted, after trimming.
NUMBER_PATTERN = r"(?i)^\s*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity)\s*$"
# day/month/two-digit-year text; years from 69 on belong to 19xx.
DAY_MONTH_YEAR_PATTERN = r"^\d{1,2}/\d{1,2}/\d{2}$"
FIRST_WRAPPED_YEAR = 2069

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATING = (T.FloatType, T.DoubleType)


def family(dtype: T.DataType) -> str:
    """Family a type belongs to; values of different families never compare equal."""
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return TEXT
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return NUMBER
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATETIME
    if isinstance(dtype, T.NullType):
        return EMPTY
    raise TypeError(f"type {dtype.simpleString()} cannot be reconciled; flatten it to scalar columns first")


def is_integral(dtype: T.DataType) -> bool:
    return isinstance(dtype, _INTEGRAL)


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, _FLOATING)


def clean(col: Column, dtype: T.DataType) -> Column:
    """NaN means "no value" everywhere, so turn it into NULL."""
    return F.when(~F.isnan(col), col) if is_floating(dtype) else col


def null_test(col: Column, dtype: T.DataType) -> Column:
    """True for NULL and for NaN; never NULL itself."""
    return col.isNull() | F.isnan(col) if is_floating(dtype) else col.isNull()


def as_number(col: Column, dtype: T.DataType) -> Column:
    """Number behind a value as a double; anything that is no number is NULL."""
    kind = family(dtype)
    if kind == TEXT:
        return F.when(col.rlike(NUMBER_PATTERN), F.trim(col).try_cast("double"))
    if kind == NUMBER:
        return clean(col.cast("double"), T.DoubleType())
    if kind == DATETIME:
        ntz = col.cast("timestamp_ntz")
        micros = F.timestamp_diff("MICROSECOND", F.lit(datetime(1970, 1, 1)).cast("timestamp_ntz"), ntz)
        return micros.cast("double") * F.lit(1000.0)
    return F.lit(None).cast("double")


def _floating_text(col: Column, dtype: T.DataType) -> Column:
    plain = col.cast("string")
    mantissa = F.substring_index(plain, "E", 1)
    exponent = F.substring_index(plain, "E", -1).try_cast("int")
    digits = F.regexp_replace(plain.try_cast("decimal(38,22)").cast("string"), "0+$", "")
    unfolded = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    size = F.abs(exponent).cast("string")
    scientific = F.concat(
        F.regexp_replace(mantissa, r"\.0$", ""),
        F.when(exponent < 0, "e-").otherwise("e+"),
        F.when(F.length(size) < 2, F.concat(F.lit("0"), size)).otherwise(size),
    )
    infinite = F.abs(col) == F.lit(float("inf")).cast(dtype)
    return (
        F.when(F.isnan(col), F.lit(None))
        .when(infinite, F.when(col > 0, "inf").otherwise("-inf"))
        .when(~plain.contains("E"), plain)
        .when(exponent.between(-4, 15), unfolded)
        .otherwise(scientific)
    )


def as_text(col: Column, dtype: T.DataType) -> Column:
    """Text of a value as Python's ``str`` writes it; NULL and NaN stay NULL."""
    if family(dtype) == TEXT:
        return col.cast("string")
    if isinstance(dtype, T.BooleanType):
        return F.when(col, "True").when(~col, "False")
    if is_floating(dtype):
        return _floating_text(col, dtype)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
        micros = F.date_format(col, "SSSSSS")
        return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))
    return col.cast("string")


def day_month_year(col: Column, dtype: T.DataType) -> Column:
    """Date behind ``d/m/yy`` text (or a date/time value); anything else is NULL."""
    if family(dtype) == DATETIME:
        return col.cast("date")
    if family(dtype) != TEXT:
        return F.lit(None).cast("date")
    parsed = F.try_to_timestamp(F.when(col.rlike(DAY_MONTH_YEAR_PATTERN), col), F.lit("d/M/yy")).cast("date")
    return F.when(F.year(parsed) >= FIRST_WRAPPED_YEAR, F.add_months(parsed, -1200)).otherwise(parsed)


def round_half_even(col: Column, places: int) -> Column:
    """Scale, round ties to even, scale back."""
    scale = F.lit(10.0**places)
    return F.rint(col * scale) / scale


def python_number(value: Any) -> float | None:
    """Number behind a spec value, or None when it is not one."""
    if value is None:
        return None
    try:
        number = float(value)
    except (TypeError, ValueError):
        return None
    return None if math.isnan(number) else number


def number_literal(value: float, dtype: T.DataType) -> Column:
    """Literal in the column's own type when exact, so the comparison can reach the scan."""
    if is_integral(dtype) and value.is_integer() and abs(value) < 2**53:
        return F.lit(int(value))
    return F.lit(value)


def fits_family(value: Any, dtype: T.DataType) -> bool:
    """Whether a spec value can equal a value of this type at all."""
    kind = family(dtype)
    if kind == TEXT:
        return isinstance(value, str)
    if kind == NUMBER:
        return isinstance(value, (bool, int, float))
    if kind == DATETIME:
        return isinstance(value, (date, datetime))
    return False


_WHOLE_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def held_as(value: Any, dtype: T.DataType) -> list[Any]:
    """The value as a column of this type holds it, in a list; an empty list if it cannot hold it exactly."""
    if not fits_family(value, dtype) or isinstance(value, float) and math.isnan(value):
        return []
    if family(dtype) == TEXT:
        return [value]
    if family(dtype) == DATETIME:
        if not isinstance(dtype, T.DateType):
            return [value if isinstance(value, datetime) else datetime(value.year, value.month, value.day)]
        if isinstance(value, datetime):
            return [value.date()] if value == datetime(value.year, value.month, value.day) else []
        return [value]
    if isinstance(dtype, T.BooleanType):
        return [bool(value)] if value in (0, 1) else []
    if is_floating(dtype):
        return [float(value)] if abs(value) < 1e308 and (isinstance(value, float) or float(value) == value) else []
    if math.isinf(value):
        return []
    if isinstance(dtype, T.DecimalType):
        exact = Decimal(str(value)) if isinstance(value, float) else Decimal(int(value))
        fits = exact == round(exact, dtype.scale) and abs(exact) < Decimal(10) ** (dtype.precision - dtype.scale)
        return [round(exact, dtype.scale)] if fits else []
    bits = _WHOLE_BITS[type(dtype)]
    return [int(value)] if value == int(value) and -(1 << bits - 1) <= value < 1 << bits - 1 else []


def literal_like(value: Any, dtype: T.DataType) -> Column:
    if value is None:
        return F.lit(None).cast(dtype)
    return F.lit(value).cast(dtype)


def is_plain_text(pattern: str) -> bool:
    """Whether a pattern has no regular-expression syntax in it."""
    return re.escape(pattern) == pattern or re.fullmatch(r"[\w\s,:;@%&=<>!'\"/#~`-]*", pattern) is not None
