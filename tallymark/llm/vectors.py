"""Vectors as numbers: which take part, copies as one, and leading principal dimensions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of little-endian doubles as a matrix."""
    rows = column.to_pylist()
    return np.stack([np.frombuffer(r, "<f8") for r in rows]) if rows else np.zeros((0, 0))


def packed(vectors: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(v, "<f8").tobytes() for v in vectors], pa.binary())


def takes_part(id_column: str, vector: str) -> Column:
    """Whether a row has an id and a vector of finite numbers that is not zero; never null."""
    values = F.col(vector).cast("array<double>")
    fine = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(id_column).isNotNull() & fine & F.exists(values, lambda x: x != 0), F.lit(False))


def usable(rows: DataFrame, id_column: str, vector: str, *more: str) -> DataFrame:
    """Ids (whole numbers), vectors as binary doubles and further columns, without the rows that take no part.

    These are vectors that are null, empty or zero, or hold null or non-finite components, and
    rows without an id.
    """
    bare = rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), *more)
    bare = bare.filter(takes_part("id", "vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            raw = [np.array(v, "<f8").tobytes() for v in column.to_pylist()]
            rest = [batch.column(c) for c in ("id", *more)]
            yield pa.record_batch([rest[0], pa.array(raw, pa.binary()), *rest[1:]], names=["id", "vector", *more])

    kinds = dict(bare.dtypes)
    return bare.mapInArrow(run, ", ".join(["id long", "vector binary", *(f"{c} {kinds[c]}" for c in more)]))


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaled by their largest component first, so that no square is lost or overflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def principal(vectors: DataFrame, unit: bool) -> tuple[np.ndarray, np.ndarray]:
    """Mean and principal directions, the leading one first, from sums over all vectors.

    Each task adds up its vectors' products; what reaches the driver has one row a dimension.
    All vectors must have the same number of dimensions. With ``unit`` they are scaled to length 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = matrix(batch.column("vector"))
            if len(x):
                x = unit_rows(x) if unit else x
                x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            rows = np.arange(len(total))
            for start in range(0, len(total), 64):
                some = rows[start : start + 64]
                values = total[some].ravel()
                yield pa.record_batch(
                    [pa.array(np.repeat(some, len(total))), pa.array(np.tile(rows, len(some))), pa.array(values)],
                    names=["i", "j", "value"],
                )

    sums = vectors.select("vector").mapInArrow(run, "i long, j long, value double").groupBy("i", "j").agg(F.sum("value"))
    rows = sums.collect()  # dimensions squared, whatever the number of vectors
    if not rows:
        return np.zeros(0), np.zeros((0, 0))
    size = max(r[0] for r in rows) + 1
    total = np.zeros((size, size))
    for i, j, value in rows:
        total[i, j] = value
    count = total[-1, -1]
    mean = total[-1, :-1] / count
    spread = total[:-1, :-1] / count - np.outer(mean, mean)
    _, directions = np.linalg.eigh(spread)
    return mean, directions[:, ::-1]
