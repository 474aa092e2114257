"""Ready-made field transformations, all built-in expressions.

Each takes and returns a Column, so any of them can be a field's
``transformation``. They expect text unless noted.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymark.functions.values import NUMBER_PATTERN

_EDGE_SPACE = r"(?U)^\s+|\s+$"


def _number(text: Column) -> Column:
    return F.when(text.rlike(NUMBER_PATTERN), F.trim(text).try_cast("double"))


def strip(col: Column) -> Column:
    """Drop all leading and trailing white space."""
    return F.regexp_replace(col, _EDGE_SPACE, "")


def dashed_date(col: Column) -> Column:
    """Trim, then write slashes as dashes."""
    return F.replace(strip(col), F.lit("/"), F.lit("-"))


def rounded(places: int = 2):
    """Number rounded half-even to ``places``."""
    return lambda col: F.bround(_number(col.cast("string")), places)


def upper_trimmed(col: Column) -> Column:
    return F.upper(strip(col))


def lower(col: Column) -> Column:
    return F.lower(col)


def number_or_zero(col: Column) -> Column:
    return F.coalesce(_number(col.cast("string")), F.lit(0.0))


def currency_amount(col: Column) -> Column:
    """Number behind texts such as ``$1,234.50`` or ``USD 12``."""
    return _number(F.regexp_replace(col.cast("string"), r"[$,]|USD", ""))


def alphanumeric_upper(col: Column) -> Column:
    return F.upper(F.regexp_replace(col.cast("string"), r"[^\p{L}\p{N}]", ""))


def percent_fraction(col: Column) -> Column:
    """``12%`` becomes 0.12; plain numbers stay."""
    text = col.cast("string")
    return F.when(text.contains("%"), _number(F.regexp_replace(text, "%", "")) / 100).otherwise(_number(text))


# Flag texts and the boolean each stands for.
FLAG_TEXTS = {
    "Yes": True,
    "No": False,
    "Y": True,
    "N": False,
    "1": True,
    "0": False,
    "Settled": True,
    "Pending": False,
}
