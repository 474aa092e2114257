"""Value mapping, conditional mapping and transformation of one side.

Spec dictionaries are small by nature; up to ``INLINE_ENTRIES`` entries become
a map literal, larger ones a broadcast lookup table, whose size is the size of
the spec and never that of the data.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions import values as V
from tallymark.functions.predicates import (
    LIST_CONDITIONS,
    NULL_CONDITIONS,
    NUMBER_CONDITIONS,
    predicate,
)
from tallymark.plans.spec import ConditionalMapping, ValueExpression

log = logging.getLogger(__name__)

INLINE_ENTRIES = 64


@dataclass(frozen=True)
class _Lookup:
    """A mapping restricted to keys the column can hold, with its result type settled."""

    entries: dict[Any, Any]
    result: T.DataType


def _result_type(dtype: T.DataType, new_values: list[Any]) -> T.DataType:
    """Type after mapping: the column's own family when all new values fit it, else text."""
    present = [v for v in new_values if v is not None]
    if not present or isinstance(dtype, T.NullType):
        return dtype
    if not all(V.fits_family(v, dtype) for v in present):
        return T.StringType()
    if V.family(dtype) == V.NUMBER:
        flags = all(isinstance(v, bool) for v in present)
        if isinstance(dtype, T.BooleanType) and flags:
            return dtype
        fractional = any(isinstance(v, float) for v in present)
        if fractional or not (V.is_integral(dtype) or isinstance(dtype, T.BooleanType)):
            return T.DoubleType()
        return T.LongType()
    return dtype


def _restrict(mapping: Mapping[Any, Any], dtype: T.DataType) -> _Lookup:
    """Keys converted once for both forms; equal ones after conversion are one key, the last wins."""
    entries = {held: new for old, new in mapping.items() for held in V.held_as(old, dtype)}
    return _Lookup(entries, _result_type(dtype, list(entries.values())))


def _convert(col: Column, dtype: T.DataType, result: T.DataType) -> Column:
    if dtype == result:
        return col
    if isinstance(result, T.StringType):
        return V.as_text(col, dtype)
    return V.clean(col, dtype).cast(result)


def _new_value(value: Any, result: T.DataType) -> Column:
    if value is not None and isinstance(result, T.StringType):
        value = str(value)
    return V.literal_like(value, result)


def _map_literal(lookup: _Lookup, dtype: T.DataType) -> Column:
    pairs: list[Column] = []
    for old, new in lookup.entries.items():
        pairs += [V.literal_like(old, dtype), _new_value(new, lookup.result)]
    return F.create_map(*pairs)


def _replacements(new_values: list[Any], result: T.DataType) -> list[Any]:
    """New values as a column of the result type holds them."""
    if isinstance(result, T.StringType):
        return [None if new is None else str(new) for new in new_values]
    if isinstance(result, T.DoubleType):
        return [None if new is None else float(new) for new in new_values]
    return new_values


def _lookup_frame(df: DataFrame, lookup: _Lookup, dtype: T.DataType, names: tuple[str, str]) -> DataFrame:
    schema = T.StructType([T.StructField(names[0], dtype), T.StructField(names[1], lookup.result)])
    news = _replacements(list(lookup.entries.values()), lookup.result)
    return df.sparkSession.createDataFrame(list(zip(lookup.entries, news)), schema)


def mapped(col: Column, dtype: T.DataType, mapping: Mapping[Any, Any]) -> tuple[Column, T.DataType] | None:
    """Plain mapping as an expression with its type; None when it is too long to write inline."""
    lookup = _restrict(mapping, dtype)
    if not lookup.entries:
        return col, dtype
    if len(lookup.entries) > INLINE_ENTRIES:
        return None
    kept = _convert(col, dtype, lookup.result)
    return F.coalesce(F.try_element_at(_map_literal(lookup, dtype), col), kept), lookup.result


def map_values(df: DataFrame, field: str, mapping: Mapping[Any, Any]) -> DataFrame:
    """Replace exact typed matches; other values, nulls and null replacements stay as they are."""
    dtype = df.schema[field].dataType
    col = F.col(f"`{field}`")
    inline = mapped(col, dtype, mapping)
    if inline is not None:
        return df.withColumn(field, inline[0])
    lookup = _restrict(mapping, dtype)
    old, new = f"__old_{field}", f"__new_{field}"
    table = F.broadcast(_lookup_frame(df, lookup, dtype, (old, new)))  # as large as the spec, not the data
    joined = df.join(table, col == F.col(f"`{old}`"), "left")
    return joined.withColumn(field, F.coalesce(F.col(f"`{new}`"), _convert(col, dtype, lookup.result))).drop(old, new)


def condition_mask(mapping: ConditionalMapping, col: Column, dtype: T.DataType) -> Column | None:
    """Mask of a typed condition; None when the mapping is of the keyed form."""
    kind = mapping.condition_type
    if kind in NULL_CONDITIONS:
        return predicate(col, dtype, kind)
    if kind in LIST_CONDITIONS:
        if not mapping.condition_list:
            return None
        return predicate(col, dtype, kind, values=mapping.condition_list, numeric_equality=False)
    if not mapping.condition_value:
        return None
    if kind in NUMBER_CONDITIONS and V.python_number(mapping.condition_value) is None:
        log.warning("conditional mapping: %r is no number, nothing is mapped", mapping.condition_value)
        return F.lit(False)
    return predicate(col, dtype, kind, mapping.condition_value, numeric_equality=False)


def _cases(mapping: ConditionalMapping, dtype: T.DataType, cond: Column, cond_type: T.DataType) -> list[tuple[Any, Column, dict]]:
    """Cases in order: the condition value they hold for (None with a typed condition), the test, and old to new values."""
    mask = condition_mask(mapping, cond, cond_type)
    if mask is not None:
        cases = [(None, mask, mapping.mappings.get("default", {}))]
    else:
        cases = [
            (held, cond.isNotNull() & (cond == V.literal_like(held, cond_type)), old_to_new)
            for key, old_to_new in mapping.mappings.items()
            for held in V.held_as(key, cond_type)
        ]
    restricted = [(held, test, _restrict(m, dtype).entries) for held, test, m in cases]
    return [case for case in restricted if case[2]]


def mapped_where(
    col: Column, dtype: T.DataType, mapping: ConditionalMapping, cond: Column, cond_type: T.DataType
) -> tuple[Column, T.DataType] | None:
    """Conditional mapping as an expression with its type; None when it is too long to write inline.

    A replacement of None clears the value here, unlike in the plain mapping.
    """
    cases = _cases(mapping, dtype, cond, cond_type)
    if not cases:
        return col, dtype
    if sum(len(entries) for _, _, entries in cases) > INLINE_ENTRIES:
        return None
    result = _result_type(dtype, [new for _, _, entries in cases for new in entries.values()])
    replaced = _convert(col, dtype, result)
    for _, test, entries in cases:  # a later case wins, as it would when applied in order
        hit = test & col.isNotNull() & col.isin([V.literal_like(old, dtype) for old in entries])
        new = F.try_element_at(_map_literal(_Lookup(entries, result), dtype), col)
        replaced = F.when(hit, new).otherwise(replaced)
    return replaced, result


def map_values_where(df: DataFrame, field: str, mapping: ConditionalMapping, condition_field: str) -> DataFrame:
    """Conditional mapping of any length: the rules as rows, met in one broadcast join.

    A rule has the old value and, in the keyed form, the condition value; of rules that agree in
    both, the last case's is kept, so a row meets one rule at most.
    """
    dtype, cond_type = df.schema[field].dataType, df.schema[condition_field].dataType
    col, cond = F.col(f"`{field}`"), F.col(f"`{condition_field}`")
    cases = _cases(mapping, dtype, cond, cond_type)
    keyed = bool(cases) and cases[0][0] is not None
    rules = {(held, old): new for held, _, entries in cases for old, new in entries.items()}
    result = _result_type(dtype, list(rules.values()))
    held_, old_, new_, hit_ = (f"__{part}_{field}" for part in ("held", "old", "new", "hit"))
    kinds = [(held_, cond_type), (old_, dtype), (new_, result), (hit_, T.BooleanType())]
    news = _replacements(list(rules.values()), result)
    rows = [(held, old, new, True) for (held, old), new in zip(rules, news)]
    table = df.sparkSession.createDataFrame(rows, T.StructType([T.StructField(*k) for k in kinds]))
    on = col == F.col(f"`{old_}`")
    if keyed:
        on = on & (cond == F.col(f"`{held_}`"))
    joined = df.join(F.broadcast(table), on, "left")  # as large as the spec, not the data
    hit = F.coalesce(F.col(f"`{hit_}`"), F.lit(False))
    if not keyed:
        hit = hit & cases[0][1]
    value = F.when(hit, F.col(f"`{new_}`")).otherwise(_convert(col, dtype, result))
    return joined.withColumn(field, value).drop(held_, old_, new_, hit_)


def transformed(col: Column, dtype: T.DataType, expression: ValueExpression) -> Column:
    """An expression applied to the values that are present; nulls stay null.

    SQL text names the field, so the field must already hold the value to transform.
    """
    new = F.expr(expression) if isinstance(expression, str) else expression(col)
    return F.when(~V.null_test(col, dtype), new)


def cast_to(col: Column, dtype: T.DataType, type_name: str) -> Column:
    """A value in its field's declared type; what cannot be read as it becomes null."""
    if dtype.simpleString() == type_name:
        return col
    if V.family(dtype) == V.TEXT and type_name in ("double", "bigint", "int"):
        return V.as_number(col, dtype).try_cast(type_name)
    return V.as_text(col, dtype) if type_name == "string" else col.try_cast(type_name)


class ColumnUpdates:
    """Updates of a table's columns, gathered so that independent ones share a projection.

    A wide spec thereby stays a few projections instead of one per field.
    """

    def __init__(self, df: DataFrame):
        self._df = df
        self._pending: dict[str, Column] = {}
        self._types: dict[str, T.DataType | None] = {f.name: f.dataType for f in df.schema.fields}

    def column(self, name: str) -> Column:
        return self._pending.get(name, F.col(f"`{name}`"))

    def dtype(self, name: str) -> T.DataType:
        if self._types[name] is None:
            self.settle()
        return self._types[name]

    def set(self, name: str, col: Column, dtype: T.DataType | None = None) -> None:
        """Update a column; its type may be left for Spark to find out."""
        self._pending[name] = col
        self._types[name] = dtype

    def settle(self) -> DataFrame:
        """The table with all updates made so far."""
        if self._pending:
            self._df = self._df.withColumns(self._pending)
            self._pending = {}
            self._types = {f.name: f.dataType for f in self._df.schema.fields}
        return self._df

    def replace(self, df: DataFrame) -> None:
        self.__init__(df)

    def has(self, name: str) -> bool:
        return name in self._types

    # -- field steps -----------------------------------------------------------

    def map(self, name: str, mapping: Mapping[Any, Any]) -> None:
        inline = mapped(self.column(name), self.dtype(name), mapping)
        if inline is None:
            self.replace(map_values(self.settle(), name, mapping))
        else:
            self.set(name, *inline)

    def map_where(self, name: str, mapping: ConditionalMapping, condition_column: str) -> None:
        if not self.has(condition_column):
            log.warning("condition field %r not found; %r is left as it is", mapping.condition_field, name)
            return
        dtypes = self.dtype(name), self.dtype(condition_column)
        cond = self.column(condition_column)  # as it stands now, so an earlier mapping is seen
        inline = mapped_where(self.column(name), dtypes[0], mapping, cond, dtypes[1])
        if inline is None:
            self.replace(map_values_where(self.settle(), name, mapping, condition_column))
        else:
            self.set(name, *inline)

    def transform(self, name: str, expression: ValueExpression) -> None:
        if isinstance(expression, str) and any(updated.lower() in expression.lower() for updated in self._pending):
            self.settle()  # the text may name an updated column, in any case
        dtype = self.dtype(name)
        self.set(name, transformed(self.column(name), dtype, expression))

    def cast(self, name: str, type_name: str) -> None:
        dtype = self.dtype(name)
        self.set(name, cast_to(self.column(name), dtype, type_name))


def python_transformation(function: Callable[[Any], Any], return_type: str) -> Callable[[Column], Column]:
    """Wrap a per-value Python function as an Arrow-batched transformation.

    Only for logic that has no built-in expression; prefer those.
    """

    def apply(batch: pd.Series) -> pd.Series:
        return batch.map(function, na_action="ignore")

    def expression(col: Column) -> Column:
        return F.pandas_udf(apply, return_type)(col)

    expression.__name__ = getattr(function, "__name__", "python")
    return expression
