"""Connected components of links between records, in rounds of joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.shared import settle

#: Links that a task contracts together.
LINKS_PER_TASK = 400_000


def components(links: DataFrame, name: str) -> DataFrame:
    """(node, root) for every end of a link (a, b); the root is the smallest node reachable.

    Each round first contracts the links of each task, a bounded number, to stars around their
    smallest nodes; few links are thereby done at once. What spans tasks takes two further
    steps: every node tells its larger neighbours of its smallest neighbour, then its smaller
    ones. All keep what is connected, and rounds end when links do not change. Each round is
    written, so lineage stays short.
    """
    edges = settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v"), name)
    state = None
    while True:
        tasks = -(-edges.count() // LINKS_PER_TASK)
        stars = contracted(edges, max(1, tasks))
        if tasks <= 1:
            edges = settle(stars, name)
            break
        before, state = state, _digest(edges)
        if state == before:
            break
        both = stars.union(stars.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = large.join(least, "u").select(F.explode(pairs).alias("p")).select("p.*").filter("u <> v").distinct()
        edges = settle(small, name)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def contracted(edges: DataFrame, tasks: int) -> DataFrame:
    """The same components within each task, as links of each node to the smallest one of its component there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def top(node):
            while (above := parent.setdefault(node, node)) != node:
                parent[node] = parent[above]
                node = above
            return node

        kinds = None
        for batch in batches:
            kinds = [batch.column(c).type for c in ("u", "v")]
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
                x, y = top(u), top(v)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        found = [(node, top(node)) for node in parent]
        found = [(node, root) for node, root in found if node != root]
        if found:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=["u", "v"])

    return edges.coalesce(tasks).mapInArrow(run, edges.schema)


def _digest(edges: DataFrame) -> tuple:
    hash_ = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(hash_)).first())
