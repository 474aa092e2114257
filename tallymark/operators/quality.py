"""Dataset checks, profile and clean-up."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions import values as V

log = logging.getLogger(__name__)

# Texts that stand for a missing value when standardizing.
NULL_TEXTS = ("NULL", "null", "N/A", "n/a", "NaN", "nan", "None", "none", "")


def _nulls(df: DataFrame, name: str):
    return V.null_test(F.col(f"`{name}`"), df.schema[name].dataType)


def _null_test_any(df: DataFrame, name: str):
    dtype = df.schema[name].dataType
    return _nulls(df, name) if V.is_floating(dtype) else F.col(f"`{name}`").isNull()


def dataset_check(df: DataFrame) -> DataFrame:
    """One row: rows, columns, and the columns that hold no value at all (comma separated)."""
    if not df.columns:
        raise ValueError("dataset has no columns")
    filled = [F.count_if(~_null_test_any(df, c)).alias(f"__{i}") for i, c in enumerate(df.columns)]
    counted = df.agg(F.count(F.lit(1)).alias("rows"), *filled)
    empty = [F.when(F.col(f"__{i}") == 0, F.lit(c)) for i, c in enumerate(df.columns)]
    return counted.select(
        "rows",
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        F.array_join(F.array(*empty), ",").alias("empty_columns"),
    )


def check_dataset(df: DataFrame, name: str = "dataset") -> DataFrame:
    """Refuse a table without columns or rows; warn about columns without values."""
    row = dataset_check(df).first()
    if row["rows"] == 0:
        raise ValueError(f"{name} is empty")
    if row["empty_columns"]:
        log.warning("%s has completely empty columns: %s", name, row["empty_columns"])
    return df


def profile_columns(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type and count of missing values."""
    counted = df.agg(*[F.count_if(_null_test_any(df, c)).alias(f"__{i}") for i, c in enumerate(df.columns)])
    rows = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("type"),
            F.col(f"__{i}").alias("null_count"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return counted.select(F.inline(F.array(*rows)))


def profile(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing values and duplicate rows.

    Equal rows are folded map-side, so a large group of copies costs one row per task.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    folded = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__rows"))
    missing = sum((F.when(_null_test_any(df, c), 1).otherwise(0) for c in df.columns), F.lit(0))
    return folded.agg(
        F.coalesce(F.sum("__rows"), F.lit(0)).alias("rows"),
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        F.coalesce(F.sum(missing * F.col("__rows")), F.lit(0)).alias("total_nulls"),
        F.coalesce(F.sum(F.col("__rows") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def standardize(df: DataFrame, *, strip_strings: bool = True, standardize_nulls: bool = True) -> DataFrame:
    """Trim text columns and turn texts that stand for a missing value into NULL."""
    columns = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            if strip_strings:
                stripped = F.regexp_replace(col, r"(?U)^\s+|\s+$", "")
                col = F.when(stripped != "", stripped)
            if standardize_nulls:
                col = F.when(~col.isin(*NULL_TEXTS), col)
        columns.append(col.alias(field.name))
    return df.select(*columns)


def clean_names(df: DataFrame, *, collapse: bool = False) -> DataFrame:
    """Strip column names; ``collapse`` also folds inner line breaks and spaces into one space."""
    return df.toDF(*[" ".join(c.split()) if collapse else c.strip() for c in df.columns])
