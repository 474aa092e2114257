"""Row filters of one side."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.predicates import field_predicate
from tallymark.plans.spec import Filter


def filter_mask(df: DataFrame, filters: Sequence[Filter]) -> Column:
    tests = [field_predicate(df, f.field, f.condition, f.value, f.values) for f in filters]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def apply_filters(df: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    """Rows meeting every filter."""
    return df.filter(filter_mask(df, filters)) if filters else df


def filter_counts(df: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    """One row: rows before, removed by the filters, and left."""
    mask = filter_mask(df, filters)
    return df.agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(~mask).alias("rows_removed"),
        F.count_if(mask).alias("rows_left"),
    )
