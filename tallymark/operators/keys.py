"""Key calculations, alternative keys, key checks and duplicate keys."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions import values as V
from tallymark.operators.folding import count_equal, plain, rows_to_deal, tasks_for
from tallymark.plans.spec import Key, frame_expression

log = logging.getLogger(__name__)


def calculate_keys(df: DataFrame, keys: Sequence[Key], side: str) -> DataFrame:
    """Overwrite key columns that the spec computes from the whole row."""
    for key in keys:
        expression = key.calculation(side)
        if expression is not None:
            df = df.withColumn(key.column(side), frame_expression(df, expression))
    return df


def expand_alternative_keys(df: DataFrame, keys: Sequence[Key], *, drop_null_alternatives: bool = False) -> DataFrame:
    """Append target rows re-keyed by alternative columns.

    A row is appended when its alternative value is no primary key value of the
    table. Primary values are taken once per key, so alternatives do not exclude
    each other. Rows without an alternative value become null-key rows unless
    dropped. Each key reads the table twice, whatever the number of alternatives.
    """
    total = 0
    for key in keys:
        present = [a for a in key.target_alternatives if a in df.columns]
        for missing in set(key.target_alternatives) - set(present):
            log.warning("alternative key column %r not found in target", missing)
        if not present:
            continue
        primary = key.target
        total = total or rows_to_deal(df)
        taken = count_equal(df.select(F.col(f"`{primary}`").alias("__taken")).filter("__taken is not null"), total)
        taken = taken.select("__taken")
        values = [F.struct(F.col(f"`{c}`").alias("value"), F.lit(c == primary).alias("own")) for c in (primary, *present)]
        # one pass: each row with its own and its alternative values, then one anti join for the latter
        rows = df.withColumn("__key", F.explode(F.array(*values)))
        if drop_null_alternatives:
            rows = rows.filter("__key.own or __key.value is not null")
        total *= len(values)
        tasks, kind = tasks_for(total), rows.schema["__key"].dataType["value"].dataType
        clash = (F.col("__key.value") == F.col("__taken")) & ~F.col("__key.own")
        if tasks > 1 and plain(kind) and taken.schema["__taken"].dataType == kind:
            # values that are not asked for are no key of the join, and are dealt by where they come from
            asked = F.when(~F.col("__key.own"), F.col("__key.value"))
            anywhere = F.xxhash64(F.spark_partition_id(), F.col(f"`{primary}`"))
            rows = rows.withColumn("__asked", asked).withColumn(
                "__place", F.when(F.col("__asked").isNotNull(), F.xxhash64("__asked")).otherwise(anywhere)
            )
            rows = rows.repartition(tasks, "__asked", "__place")
            taken = taken.withColumn("__taken_place", F.xxhash64("__taken")).repartition(tasks, "__taken", "__taken_place")
            clash = (F.col("__asked") == F.col("__taken")) & (F.col("__place") == F.col("__taken_place"))
        free = rows.join(taken, clash, "left_anti")
        df = free.withColumn(primary, F.col("__key.value")).drop("__key", "__asked", "__place")
    return df


def check_key_families(source: DataFrame, target: DataFrame, names: Sequence[str]) -> None:
    """Keys must be there on both sides and be of one family."""
    for side, df in (("source", source), ("target", target)):
        missing = [n for n in names if n not in df.columns]
        if missing:
            raise ValueError(f"missing reconciliation keys in {side} data: {missing}")
    for name in names:
        s, t = source.schema[name].dataType, target.schema[name].dataType
        if V.EMPTY not in (V.family(s), V.family(t)) and V.family(s) != V.family(t):
            raise ValueError(f"key {name!r} is {s.simpleString()} in source but {t.simpleString()} in target")


def duplicate_keys(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with their row counts (counted before they are shuffled)."""
    return count_equal(df.select(*[F.col(f"`{n}`") for n in names]), rows_to_deal(df), "row_count").filter("row_count > 1")
