"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors are close in cosine exactly if they are close in distance. They are sorted by the
cells of a grid as wide as that distance, on the leading principal dimensions. Intervals of the
sorted sequence are joined recursively, from large ones down to blocks and, inside a task, to
small runs: pairs of intervals whose bounding boxes are provably farther apart are skipped.
Copies are joined as one vector with a weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.graph import components
from tallymark.llm.shared import settle
from tallymark.llm.vectors import matrix, packed, principal, takes_part, unit_rows, usable

#: Leading principal dimensions that order the vectors and bound their boxes.
DIMENSIONS = 8
#: Vectors in a block, the unit that is sent to meet another, and in a run, below which all pairs are compared.
BLOCK, RUN = 1024, 64
#: Intervals that make up the next larger one, as a power of two.
FAN_BITS = 3


def reach(similarity: float) -> float:
    """The distance of unit vectors with that cosine, and a little for rounding."""
    return float(np.sqrt(max(2 - 2 * similarity, 0.0))) * (1 + 1e-9) + 1e-7


def near(x: str, y: str, dims: int, width: float) -> Column:
    """Whether boxes of two intervals may hold points within the distance."""
    gaps = [
        F.greatest(F.col(f"{x}.lo{d}") - F.col(f"{y}.hi{d}"), F.col(f"{y}.lo{d}") - F.col(f"{x}.hi{d}"), F.lit(0.0))
        for d in range(dims)
    ]
    return sum((g * g for g in gaps), F.lit(0.0)) <= width * width


def blocks_of(nodes: DataFrame, directions: np.ndarray, width: float) -> DataFrame:
    """Blocks of vectors in grid order: label, number of partition and block, box, and the vectors."""
    dims = directions.shape[1]
    cells, boxes = [f"cell{d}" for d in range(dims)], [f"{end}{d}" for d in range(dims) for end in ("lo", "hi")]
    kind = dict(nodes.dtypes)["label"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = np.floor(unit_rows(matrix(batch.column("vector"))) @ directions / width).astype(np.int32)
                yield pa.record_batch(
                    [*(batch.column(c) for c in ("label", "node", "copies", "vector")), *(pa.array(c) for c in cell.T)],
                    names=["label", "node", "copies", "vector", *cells],
                )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, label, held, rows = TaskContext.get().partitionId(), 0, None, [], 0

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            x = unit_rows(matrix(table.column("vector")))
            y = x @ directions
            values = {
                "label": held[0].column("label").slice(0, 1),
                "part": pa.array([part], pa.int64()),
                "block": pa.array([(part << 32) + number], pa.int64()),
                **{f"lo{d}": pa.array([y[:, d].min()]) for d in range(dims)},
                **{f"hi{d}": pa.array([y[:, d].max()]) for d in range(dims)},
                "nodes": pa.array([table.column("node").to_numpy().astype("<i8").tobytes()], pa.binary()),
                "copies": pa.array([table.column("copies").to_numpy().astype("<i8").tobytes()], pa.binary()),
                "vectors": packed(x.reshape(1, -1)),
            }
            return pa.record_batch(list(values.values()), names=list(values))

        for batch in batches:
            batch = batch.select(["label", "node", "copies", "vector"])
            labels = batch.column("label").to_pylist()
            start = 0
            for i in range(len(labels) + 1):
                ends = i == len(labels) or labels[i] != label or rows + i - start >= BLOCK
                if ends:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                        rows, start = rows + i - start, i
                    if i < len(labels):
                        if rows:
                            yield block()
                            number, held, rows = number + 1, [], 0
                        label = labels[i]
        if rows:
            yield block()

    laid = nodes.mapInArrow(place, ", ".join([f"label {kind}, node long, copies long, vector binary", *(f"{c} int" for c in cells)]))
    sorted_ = laid.repartitionByRange("label", *cells, "node").sortWithinPartitions("label", *cells, "node")
    kinds = [f"label {kind}, part long, block long", *(f"lo{d} double" for d in range(dims)), *(f"hi{d} double" for d in range(dims))]
    return settle(
        sorted_.mapInArrow(cut, ", ".join([*kinds, "nodes binary, copies binary, vectors binary"])), "ego-blocks"
    ).select("label", "part", "block", *boxes, "nodes", "copies", "vectors")


def block_pairs(blocks: DataFrame, dims: int, width: float) -> DataFrame:
    """Pairs of blocks of one label that may hold close vectors, found from large intervals down to blocks.

    An interval of level k holds the blocks of 8**k partitions in a row.
    """
    boxes = [f(F.col(f"{end}{d}")).alias(f"{end}{d}") for d in range(dims) for end, f in (("lo", F.min), ("hi", F.max))]
    bounds = [f"{end}{d}" for d in range(dims) for end in ("lo", "hi")]
    leaves = blocks.select("label", F.col("part").alias("parent"), F.col("block").alias("key"), *bounds)
    last = blocks.agg(F.max("part")).first()[0] or 0
    levels = [leaves]
    shift = 0
    while True:
        key = F.shiftright("part", shift)
        levels.append(
            blocks.groupBy("label", key.alias("key"), F.shiftright(key, FAN_BITS).alias("parent")).agg(*boxes)
            .select("label", "parent", "key", *bounds)
        )
        if last >> shift == 0:
            break
        shift += FAN_BITS
    top = levels.pop()
    pairs = top.select("label", F.col("key").alias("a"), F.col("key").alias("b"))
    while levels:
        below = levels.pop()
        x, y, p = below.alias("x"), below.alias("y"), pairs.alias("p")
        found = (
            p.join(x, (F.col("p.label") == F.col("x.label")) & (F.col("p.a") == F.col("x.parent")))
            .join(y, (F.col("p.label") == F.col("y.label")) & (F.col("p.b") == F.col("y.parent")))
            .filter((F.col("p.a") < F.col("p.b")) | (F.col("x.key") <= F.col("y.key")))
            .filter(near("x", "y", dims, width))
        )
        pairs = settle(found.select("p.label", F.col("x.key").alias("a"), F.col("y.key").alias("b")), "ego-pairs")
    return pairs


def close_runs(x: np.ndarray, y: np.ndarray, same: bool, dims: int, width: float) -> Iterator[tuple[int, int, int, int]]:
    """Pairs of short runs of two sorted blocks whose boxes are not provably farther apart."""
    waiting = [(0, len(x), 0, len(y))]
    while waiting:
        a, b, c, d = waiting.pop()
        if not same or (a, b) != (c, d):
            p, q = x[a:b, :dims], y[c:d, :dims]
            gap = np.maximum(0, np.maximum(p.min(0) - q.max(0), q.min(0) - p.max(0)))
            if gap @ gap > width * width:
                continue
        if b - a <= RUN and d - c <= RUN:
            yield a, b, c, d
        elif b - a >= d - c:
            middle = (a + b) // 2
            if same and (a, b) == (c, d):
                waiting += [(a, middle, a, middle), (a, middle, middle, b), (middle, b, middle, b)]
            else:
                waiting += [(a, middle, c, d), (middle, b, c, d)]
        else:
            middle = (c + d) // 2
            waiting += [(a, b, c, middle), (a, b, middle, d)]


def joined(pairs: DataFrame, blocks: DataFrame, directions: np.ndarray, similarity: float) -> DataFrame:
    """Rows (a, b, n): with b, a link; without, that a has n more links. Links of a pair of blocks span its components."""
    dims, width = directions.shape[1], reach(similarity)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                value = {name: batch.column(name)[row].as_py() for name in batch.schema.names}
                same = value["a"] == value["b"]
                nodes = [np.frombuffer(value[f"nodes_{s}"], "<i8") for s in "xy"]
                copies = [np.frombuffer(value[f"copies_{s}"], "<i8") for s in "xy"]
                x, y = (np.frombuffer(value[f"vectors_{s}"], "<f8").reshape(len(n), -1) for s, n in zip("xy", nodes, strict=True))
                px, py = x @ directions, y @ directions
                links = [np.zeros(len(n), np.int64) for n in nodes]
                found: list[np.ndarray] = []
                for a, b, c, d in close_runs(px, py, same, dims, width):
                    hit = x[a:b] @ y[c:d].T >= similarity
                    if same and (a, b) == (c, d):
                        hit &= np.tri(b - a, dtype=bool).T & ~np.eye(b - a, dtype=bool)
                    if hit.any():
                        links[0][a:b] += hit @ copies[1][c:d]
                        links[1][c:d] += hit.T @ copies[0][a:b]
                        i, j = np.nonzero(hit)
                        found.append(np.stack([i + a, j + c + (0 if same else len(x))], axis=1))
                if not found:
                    continue
                if same:
                    links = [links[0] + links[1]]
                    nodes = nodes[:1]
                every, sums = np.concatenate(nodes), np.concatenate(links)
                spanning = span(np.concatenate(found), len(every))
                some = np.flatnonzero(sums)
                yield pa.record_batch(
                    [
                        pa.array(np.concatenate([every[some], every[spanning[:, 0]]])),
                        pa.array([None] * len(some) + every[spanning[:, 1]].tolist(), pa.int64()),
                        pa.array(np.concatenate([sums[some], np.zeros(len(spanning), np.int64)])),
                    ],
                    names=["a", "b", "n"],
                )

    held = ("nodes", "copies", "vectors")
    sides = [blocks.select(F.col("block").alias(k), *(F.col(c).alias(f"{c}_{s}") for c in held)) for k, s in (("a", "x"), ("b", "y"))]
    return pairs.select("a", "b").join(sides[0], "a").join(sides[1], "b").mapInArrow(meet, "a long, b long, n long")


def span(pairs: np.ndarray, size: int) -> np.ndarray:
    """The pairs, of numbers below ``size``, that connect what all pairs connect."""
    parent, kept = list(range(size)), []

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in pairs.tolist():
        a, b = top(i), top(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept.append((i, j))
    return np.array(kept, np.int64).reshape(-1, 2)


def link_vectors(
    rows: DataFrame, similarity: float = 0.98, *, id_column: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """Per row: its id, n_links (other rows of its label within the cosine), component_id (smallest id links reach) and kept.

    ``kept`` tells whether the row's id is its component's. Vectors that are null, empty, zero or
    hold null or non-finite components, and rows with a null label or id, link with nothing and
    are kept. Repeated rows are copies and link with each other. All vectors must have the same
    number of dimensions. Other columns are ignored whatever their names. Empty input gives no
    rows.
    """
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be above 0 and at most 1")
    bare = rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    part = settle(usable(bare, "id", "vector", "label").filter("label is not null"), "ego-vectors")
    nodes = part.groupBy("label", "vector").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))
    nodes = settle(nodes.withColumn("node", F.monotonically_increasing_id()), "ego-nodes")
    _, directions = principal(nodes, unit=True)
    directions = directions[:, :DIMENSIONS]
    width = reach(similarity)
    if directions.size:
        blocks = blocks_of(nodes, directions, width)
        found = settle(joined(block_pairs(blocks, directions.shape[1], width), blocks, directions, similarity), "ego-links")
    else:
        found = bare.sparkSession.createDataFrame([], "a long, b long, n long")
    roots = components(found.filter("b is not null").select("a", "b"), "ego-components")
    links = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    named = nodes.join(roots, "node", "left").join(links, "node", "left")
    named = named.select(
        "label", "vector", "first_id", F.coalesce("root", "node").alias("root"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    firsts = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = named.join(firsts, "root").select("label", "vector", "n_links", "component_id")
    # rows that take part carry their result by label and vector, the others have none
    linked = part.join(classes, ["label", "vector"]).select("id", "n_links", "component_id")
    linked = linked.select(F.col("id").alias(id_column), "n_links", "component_id")
    rest = bare.filter(~(F.col("label").isNotNull() & takes_part("id", "vector"))).select(
        F.col("id").alias(id_column), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")
    )
    out = linked.union(rest)
    return out.withColumn("kept", F.coalesce(F.col(id_column) == F.col("component_id"), F.lit(True)))

