"""Counting equal rows in tasks of a bounded size.

Spark deals a grouping over a set number of tasks and merges small ones by the bytes they
read, which repeated or regular values compress well: a task may then hold tens of millions of
groups. Here the number of tasks follows from the number of rows, and no task's groups grow
with the table. Equal rows of a batch are counted before anything is shuffled, so a group of
copies costs a row per batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows that one task groups, sorts or joins.
TASK_ROWS = 1_000_000

# Types whose values Arrow finds equal only if they are to Spark.
PLAIN = (
    T.StringType, T.BinaryType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
    T.DoubleType, T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType,
)


# Inputs estimated smaller than this are grouped and joined as Spark deals them.
LEAST_BYTES = 1 << 20


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def rows_to_deal(df: DataFrame) -> int:
    """The number of rows, or 0 if the input is too small to matter."""
    return df.count() if estimated_bytes(df) >= LEAST_BYTES else 0


def plain(dtype: T.DataType) -> bool:
    """Whether values of a type are equal only if they are alike; strings of a collation are not."""
    return isinstance(dtype, PLAIN) and (not isinstance(dtype, T.StringType) or dtype == T.StringType())


def tasks_for(rows: int) -> int:
    """Tasks to deal that many rows over."""
    return max(1, math.ceil(rows / TASK_ROWS))


def count_equal(df: DataFrame, rows: int, count: str = "rows", weight: str | None = None) -> DataFrame:
    """The distinct rows of ``df``, which has about ``rows`` rows, and how often each occurs, as column ``count``.

    With ``weight``, a column that is not compared, a row counts that often.
    """
    names, tasks = [n for n in df.columns if n != weight], tasks_for(rows)
    each = F.lit(1) if weight is None else F.col(f"`{weight}`")
    if tasks == 1 or not all(plain(f.dataType) for f in df.schema):
        return df.groupBy(*[F.col(f"`{n}`") for n in names]).agg(F.sum(each).cast("bigint").alias(count))
    keys = [f"k{i}" for i in range(len(names))]
    bare = df.select(*[F.col(f"`{n}`").alias(k) for n, k in zip(names, keys)], each.cast("bigint").alias("n"))
    if weight is None:
        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    table = pa.Table.from_batches([batch]).group_by(keys).aggregate([([], "count_all")])
                    yield from table.select([*keys, "count_all"]).rename_columns([*keys, "n"]).to_batches()

        bare = bare.drop("n").mapInArrow(fold, T.StructType([f if f.name != "n" else T.StructField("n", T.LongType()) for f in bare.schema]))
    # dealt by a hash, as grouping rewrites keys that are floating numbers
    dealt = bare.withColumn("place", F.xxhash64(*keys)).repartition(tasks, "place")
    return dealt.groupBy("place", *keys).agg(F.sum("n").alias(count)).drop("place").toDF(*names, count)
