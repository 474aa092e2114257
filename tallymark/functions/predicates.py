"""The condition vocabulary shared by filters and conditional mappings.

``predicate`` always returns a total boolean (never NULL). Native types are
compared natively and null tests are written out, so Catalyst can hand the
condition to the file scan.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions import values as V

log = logging.getLogger(__name__)

# Condition names a spec may use.
TEXT_CONDITIONS = (
    "equals", "not_equals", "starts_with", "not_starts_with", "ends_with", "not_ends_with",
    "contains", "not_contains", "regex_match", "regex_not_match",
)
NUMBER_CONDITIONS = ("less_than", "less_than_equal", "greater_than", "greater_than_equal")
LIST_CONDITIONS = ("in_list", "not_in_list")
LIST_ALIASES = {"in": "in_list", "not_in": "not_in_list"}
NULL_CONDITIONS = ("is_null", "is_not_null")
MAPPING_CONDITIONS = TEXT_CONDITIONS + NUMBER_CONDITIONS + LIST_CONDITIONS + NULL_CONDITIONS
FILTER_CONDITIONS = MAPPING_CONDITIONS + tuple(LIST_ALIASES)

_NEGATIONS = {
    "not_equals": "equals",
    "not_starts_with": "starts_with",
    "not_ends_with": "ends_with",
    "not_contains": "contains",
    "regex_not_match": "regex_match",
    "not_in_list": "in_list",
}


def _holds(present: Column, test: Column, negate: bool) -> Column:
    """A positive test needs a value; a negated one is also met by a missing value."""
    return ~present | ~test if negate else present & test


def _text_test(text: Column, condition: str, value: str) -> Column:
    if condition == "equals":
        return text == F.lit(value)
    if condition == "starts_with":
        return text.startswith(value)
    if condition == "ends_with":
        return text.endswith(value)
    if condition == "contains":
        return text.contains(value) if V.is_plain_text(value) else text.rlike(value)
    return text.rlike(f"^(?:{value})")


def _number_test(number: Column, condition: str, bound: Column) -> Column:
    if condition == "less_than":
        return number < bound
    if condition == "less_than_equal":
        return number <= bound
    if condition == "greater_than":
        return number > bound
    return number >= bound


def _membership(col: Column, dtype: T.DataType, values: Sequence[Any]) -> Column:
    texts = [str(v) for v in values]
    if V.is_integral(dtype):
        # an integer renders one way only, so membership can stay native
        whole = [int(t) for t in texts if t.lstrip("-").isdecimal() and str(int(t)) == t]
        whole = [w for w in whole if -(2**63) <= w < 2**63]
        return col.isin(whole) if whole else F.lit(False)
    return V.as_text(col, dtype).isin(texts)


def predicate(
    col: Column,
    dtype: T.DataType,
    condition: str,
    value: Any = None,
    values: Sequence[Any] | None = None,
    *,
    numeric_equality: bool = True,
) -> Column:
    """Condition on one column.

    ``numeric_equality`` is how filters read ``equals`` on number columns;
    conditional mappings always compare the text there.
    """
    condition = LIST_ALIASES.get(condition, condition)
    present = ~V.null_test(col, dtype)
    if condition == "is_null":
        return V.null_test(col, dtype)
    if condition == "is_not_null":
        return present

    negate = condition in _NEGATIONS
    base = _NEGATIONS.get(condition, condition)

    if base == "in_list":
        if not values:
            return F.lit(False)
        return _holds(present, _membership(col, dtype, values), negate)

    if base in TEXT_CONDITIONS:
        number = V.python_number(value)
        if base == "equals" and numeric_equality and V.family(dtype) == V.NUMBER and number is not None:
            left = col.cast("int") if isinstance(dtype, T.BooleanType) else col
            return _holds(present, left == V.number_literal(number, dtype), negate)
        text = "" if value is None else str(value)
        return _holds(present, _text_test(V.as_text(col, dtype), base, text), negate)

    if base in NUMBER_CONDITIONS:
        bound = V.python_number(value)
        if bound is None:
            log.warning("condition %s needs a number, got %r; no row satisfies it", condition, value)
            return F.lit(False)
        if V.family(dtype) == V.NUMBER and not isinstance(dtype, T.BooleanType):
            return present & _number_test(col, base, V.number_literal(bound, dtype))
        number = V.as_number(col, dtype)
        return number.isNotNull() & _number_test(number, base, F.lit(bound))

    log.warning("unknown condition %r; no row satisfies it", condition)
    return F.lit(False)


def field_predicate(
    df: DataFrame, field: str, condition: str, value: Any = None, values: Sequence[Any] | None = None
) -> Column:
    """Condition on a column of ``df``; an unknown column satisfies nothing."""
    if field not in df.columns:
        log.warning("field %r not found; no row satisfies the condition", field)
        return F.lit(False)
    return predicate(F.col(f"`{field}`"), df.schema[field].dataType, condition, value, values)
