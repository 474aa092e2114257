"""Approximate nearest neighbours by largest inner product, on a neighbour graph.

The graph is built by NN-descent: starting from neighbours within random blocks, each round joins
every vector with its neighbours and the vectors that have it as a neighbour; all of these meet
each other, and whoever finds a nearer one takes it up. Rounds end when few neighbours change.
A query walks the graph greedily: it visits the neighbours of the best vectors it has seen until
none of its best is unvisited. The best are then compared exactly, on the original vectors.

Two graphs are walked as one. The first sees vectors with one more component that gives all of
them the same length, so that it links vectors that lie near each other. The second links each
vector to those of the largest plain inner products, which are long ones; without it a walk among
vectors of differing lengths ends among the short. Where all lengths agree both graphs are the
same, and one is built. Graph and walk use 8-bit copies of the vectors, a sixteenth of the doubles,
to keep shuffles small. Equal vectors are one node.

The walk's recall is measured on a sample of the queries, which are also compared with all
vectors. If it is too low the walk is tried with a wider beam, and if that finds too little too, all
queries are compared with all vectors. Among many near copies 8 bits do not tell which are nearest;
a query whose best are so close that rounding may have hidden a better one is compared with all
vectors too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.shared import settle
from tallymark.llm.vectors import matrix, usable

#: Vectors of a random block of the first round.
BLOCK = 1024
#: Candidates that each vector takes from one meeting; more come up again at later meetings.
OFFERS = 8
#: Beams tried on the sample, as multiples of the given one; the first that finds enough serves all queries.
WIDER = (1, 4)
#: Standard errors of an 8-bit inner product within which it may stand for a better one.
ERRORS = 6
#: Most queries and bytes of their vectors that are compared with all vectors in one pass, and vectors they meet at a time.
GROUP, GROUP_BYTES, SLICE = 4096, 1 << 26, 512
#: Lengths that differ by less than this share are taken as equal.
SAME_LENGTH = 1e-6


def short(x: np.ndarray, longest: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """8-bit copies, their scales, and the component that makes all vectors as long as the longest."""
    scale = np.abs(x).max(1) / 127
    rest = np.sqrt(np.maximum(longest**2 - (x * x).sum(1), 0))
    return np.rint(x / scale[:, None]).astype(np.int8), scale, rest


def nodes_of(rows: DataFrame, id_column: str, vector: str, most: int) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors as nodes (node, vector, code, scale, rest, length), and the ``most`` smallest ids of each."""
    part = settle(usable(rows, id_column, vector), "knn-vectors")
    # nodes are numbered by their smallest ids, so ties to the smaller node are ties to the smaller id
    distinct = part.groupBy("vector").agg(F.min("id").alias("id")).orderBy("id", "vector")
    distinct = settle(distinct.select("vector", F.monotonically_increasing_id().alias("node")), "knn-distinct")

    def norm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([pa.array([float(np.linalg.norm(matrix(batch.column("vector")), axis=1).max())])], names=["norm"])

    longest = distinct.select("vector").mapInArrow(norm, "norm double").agg(F.max("norm")).first()[0] or 0.0

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                whole = matrix(batch.column("vector"))
                x, scale, rest = short(whole, longest)
                length = np.linalg.norm(whole, axis=1)
                codes = pa.array([c.tobytes() for c in x], pa.binary())
                yield pa.record_batch(
                    [batch.column("node"), batch.column("vector"), codes, pa.array(scale), pa.array(rest), pa.array(length)],
                    names=["node", "vector", "code", "scale", "rest", "length"],
                )

    coded = distinct.select("node", "vector").mapInArrow(
        code, "node long, vector binary, code binary, scale double, rest double, length double"
    )
    order = Window.partitionBy("vector").orderBy("id")
    firsts = part.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    members = settle(firsts.join(distinct, "vector").select("node", "id"), "knn-members")
    return settle(coded, "knn-nodes"), members


def inflate(batch: pa.RecordBatch, prefix: str = "") -> np.ndarray:
    """Vectors of equal length from the 8-bit copies."""
    codes = np.stack([np.frombuffer(c, np.int8) for c in batch.column(prefix + "code").to_pylist()]).astype(np.float32)
    codes *= batch.column(prefix + "scale").to_numpy().astype(np.float32)[:, None]
    return np.concatenate([codes, batch.column(prefix + "rest").to_numpy().astype(np.float32)[:, None]], axis=1)


def by_key(batches: Iterator[pa.RecordBatch], key: str, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Sorted rows regathered in batches that end where the key changes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1])
        if held and held[-1].column(key)[-1].as_py() != keys[0]:
            cuts = np.concatenate([[-1], cuts])
        if size + len(keys) >= rows and len(cuts):
            cut = int(cuts[-1]) + 1
            held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [batch.slice(cut)] if cut < len(keys) else [], len(keys) - cut
        else:
            held.append(batch)
            size += len(keys)
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def best(owner: np.ndarray, other: np.ndarray, near: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each owner's ``most`` nearest distinct others, nearest first, ties to the smaller."""
    order = np.lexsort((other, -near, owner))
    owner, other, near = owner[order], other[order], near[order]
    _, first = np.unique(np.stack([owner, other]), axis=1, return_index=True) if len(owner) else (None, np.zeros(0, int))
    first.sort()
    owner, other, near = owner[first], other[first], near[first]
    begins = np.searchsorted(owner, owner)
    keep = np.arange(len(owner)) - begins < most
    return owner[keep], other[keep], near[keep]


def lists(owner: np.ndarray, other: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
    """One row per owner, of sorted owners: the others and their nearness."""
    nodes, begins = np.unique(owner, return_index=True)
    offsets = pa.array(np.append(begins, len(owner)), pa.int32())
    return pa.record_batch(
        [
            pa.array(nodes, pa.int64()),
            pa.ListArray.from_arrays(offsets, pa.array(other, pa.int64())),
            pa.ListArray.from_arrays(offsets, pa.array(near, pa.float32())),
        ],
        names=["node", "others", "near"],
    )


LISTS = "node long, others array<long>, near array<float>"
GRAPH = f"{LISTS}, code binary, scale double, rest double"


def merged(nodes: DataFrame, offers: DataFrame, degree: int) -> DataFrame:
    """The nodes, which have lists or none yet, with the nearest of their own lists and all offered ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_key(batches, "node", 5000):
            others, near = batch.column("others"), batch.column("near")
            owner = np.repeat(batch.column("node").to_numpy(), others.value_lengths().fill_null(0).to_numpy())
            owner, other, value = best(owner, others.flatten().to_numpy(), near.flatten().to_numpy(), degree)
            whole = batch.filter(batch.column("code").is_valid())
            ids = whole.column("node").to_numpy()
            offsets = pa.array(np.append(np.searchsorted(owner, ids), len(owner)), pa.int32())
            yield pa.record_batch(
                [
                    whole.column("node"),
                    pa.ListArray.from_arrays(offsets, pa.array(other, pa.int64())),
                    pa.ListArray.from_arrays(offsets, pa.array(value, pa.float32())),
                    *(whole.column(c) for c in ("code", "scale", "rest")),
                ],
                names=["node", "others", "near", "code", "scale", "rest"],
            )

    every = nodes.unionByName(offers, allowMissingColumns=True)
    return every.repartition("node").sortWithinPartitions("node").mapInArrow(run, GRAPH)


def first_graph(nodes: DataFrame, degree: int) -> DataFrame:
    """Nearest neighbours within two independent divisions into random blocks, which connect each other."""
    blocks = max(1, -(-nodes.count() // BLOCK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_key(batches, "block", 1):
            every, every_node = inflate(batch), batch.column("node").to_numpy()
            block = batch.column("block").to_numpy()
            bounds = np.flatnonzero(np.diff(block, prepend=block[:1] - 1, append=block[-1:] + 1))
            for a, b in zip(bounds, bounds[1:], strict=False):
                x, ids = every[a:b], every_node[a:b]
                if len(ids) < 2:
                    continue
                near = x @ x.T
                np.fill_diagonal(near, -np.inf)
                most = min(-(-degree // 2), len(ids) - 1)
                found = np.argpartition(-near, most - 1, axis=1)[:, :most]
                owner = np.repeat(ids, most)
                yield lists(*best(owner, ids[found].ravel(), np.take_along_axis(near, found, 1).ravel(), most))

    parts = []
    for seed in range(2):
        block = F.pmod(F.xxhash64(F.lit(seed), "node"), F.lit(blocks))
        dealt = nodes.select("node", "code", "scale", "rest", block.alias("block"))
        parts.append(dealt.repartition("block").sortWithinPartitions("block", "node").mapInArrow(run, LISTS))
    return merged(nodes.select("node", "code", "scale", "rest"), parts[0].union(parts[1]), degree)


def meetings(graph: DataFrame, degree: int, seed: int) -> DataFrame:
    """What nodes offer each other when each one's neighbours, both ways, meet around it.

    A node that very many have as a neighbour meets ``degree`` of them, others each round.
    """
    out = graph.select(F.col("node").alias("center"), F.explode("others").alias("member"))
    pick = Window.partitionBy("center").orderBy(F.xxhash64(F.lit(seed), "center", "member"), "member")
    back = out.select(F.col("member").alias("center"), F.col("center").alias("member"))
    back = back.withColumn("rank", F.row_number().over(pick)).filter(F.col("rank") <= degree).drop("rank")
    own = graph.select(F.col("node").alias("center"), F.col("node").alias("member"))
    known = F.when(F.size("near") < degree, F.lit(float("-inf"))).otherwise(F.element_at("near", -1)).cast("float")
    member = graph.select(F.col("node").alias("member"), "code", "scale", "rest", known.alias("worst"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for batch in by_key(batches, "center"):
            center = batch.column("center").to_numpy()
            every, every_id = inflate(batch), batch.column("member").to_numpy()
            every_worst = batch.column("worst").to_numpy()
            bounds = np.flatnonzero(np.diff(center, prepend=center[:1] - 1, append=center[-1:] + 1))
            for a, b in zip(bounds, bounds[1:], strict=False):
                ids, first = np.unique(every_id[a:b], return_index=True)
                if len(ids) < 2:
                    continue
                x, worst = every[a:b][first], every_worst[a:b][first]
                near = x @ x.T
                np.fill_diagonal(near, -np.inf)
                most = min(OFFERS, len(ids) - 1)
                near[near <= worst[:, None]] = -np.inf
                found = np.argpartition(-near, most - 1, axis=1)[:, :most] if most < len(ids) - 1 else np.argsort(-near, axis=1)[:, :most]
                value = np.take_along_axis(near, found, 1)
                i, j = np.nonzero(value > -np.inf)
                waiting.append((ids[i], ids[found[i, j]], value[i, j]))
                size += len(i)
            if size > 2_000_000:
                yield lists(*best(*(np.concatenate(c) for c in zip(*waiting, strict=True)), degree))
                waiting, size = [], 0
        if size:
            yield lists(*best(*(np.concatenate(c) for c in zip(*waiting, strict=True)), degree))

    pairs = out.union(back).union(own).join(member, "member")
    return pairs.repartition("center").sortWithinPartitions("center").mapInArrow(run, LISTS)


def neighbour_graph(nodes: DataFrame, degree: int, least_change: float, most_rounds: int) -> DataFrame:
    """Per node its ``degree`` nearest others found, nearest first."""
    graph = settle(first_graph(nodes, degree), "knn-graph")
    for seed in range(most_rounds):
        found = settle(merged(graph, meetings(graph, degree, seed), degree), "knn-graph")
        before = graph.select("node", F.col("others").alias("before"))
        new = F.size(F.array_except("others", "before"))
        change = found.select("node", "others").join(before, "node").agg(F.sum(new), F.sum(F.size("others"))).first()
        graph = found
        if not change[1] or change[0] <= least_change * change[1]:
            break
    return graph


def walked_graph(nodes: DataFrame, degree: int, least_change: float, most_rounds: int) -> DataFrame:
    """Per node the others a walk goes to: its nearest, and half as many of the largest plain inner products."""
    near = neighbour_graph(nodes, degree, least_change, most_rounds)
    shortest, longest = nodes.agg(F.min("length"), F.max("length")).first()
    if longest is None or shortest >= longest * (1 - SAME_LENGTH):
        return near
    plain = neighbour_graph(nodes.withColumn("rest", F.lit(0.0)), -(-degree // 2), least_change, most_rounds)
    more = plain.select("node", F.col("others").alias("more"))
    both = F.array_union("others", "more").alias("others")
    return settle(near.join(more, "node").select("node", both, "code", "scale"), "knn-walked")


def walk(queries: DataFrame, graph: DataFrame, beam: int, step: int) -> DataFrame:
    """(query, node, near) of the best nodes seen when each query's best are all visited; queries are nodes themselves."""
    small = graph.select("node", "code", "scale")
    asked = small.select(F.col("node").alias("query"), F.col("code").alias("q_code"), F.col("scale").alias("q_scale"))
    asked = queries.join(asked, "query")
    order = Window.partitionBy("query").orderBy(F.desc("near"), "node")

    def dot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (
                    np.stack([np.frombuffer(c, np.int8) for c in batch.column(n).to_pylist()]).astype(np.float32) for n in ("q_code", "code")
                )
                near = np.einsum("ij,ij->i", x, y) * batch.column("scale").to_numpy() * batch.column("q_scale").to_numpy()
                yield pa.record_batch([batch.column("query"), batch.column("node"), pa.array(near, pa.float64())], names=["query", "node", "near"])

    def compared(pairs: DataFrame) -> DataFrame:
        return pairs.join(small, "node").join(asked, "query").mapInArrow(dot, "query long, node long, near double")

    # the walk begins at the query's own node, which is the best for unit vectors
    seen = compared(queries.withColumn("node", F.col("query"))).withColumn("visited", F.lit(False))
    while True:
        turn = F.sum(F.when(F.col("visited"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
        ranked = seen.withColumn("rank", F.row_number().over(order)).withColumn("turn", turn).filter(F.col("rank") <= beam)
        ranked = ranked.withColumn("now", ~F.col("visited") & (F.col("turn") <= step)).drop("rank", "turn")
        ranked = settle(ranked, "knn-beam")
        if ranked.filter("now").isEmpty():
            return ranked.select("query", "node", "near")
        visits = ranked.filter("now").select("query", "node").join(graph.select("node", "others"), "node")
        fresh = visits.select("query", F.explode("others").alias("node")).distinct()
        fresh = fresh.join(ranked.select("query", "node"), ["query", "node"], "left_anti")
        old = ranked.select("query", "node", "near", (F.col("visited") | F.col("now")).alias("visited"))
        met = compared(fresh).select("query", "node", "near", F.lit(False).alias("visited"))
        seen = old.union(met)


def scan(queries: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """(query, node) of the ``most`` nodes with the largest inner products, of all nodes, in doubles.

    The driver holds ``GROUP`` queries at a time; each task passes once over its nodes and keeps
    each query's best.
    """
    spark = nodes.sparkSession
    asked = settle(queries.join(nodes.select(F.col("node").alias("query"), "vector"), "query"), "knn-scanned")
    n, width = asked.agg(F.count("*"), F.max(F.length("vector"))).first()
    groups = -(-n // max(1, min(GROUP, GROUP_BYTES // (width or 1))))
    number = F.pmod(F.xxhash64("vector"), F.lit(groups))
    order = Window.partitionBy("query").orderBy(F.desc("near"), "node")
    # few parts, so that few lists are merged: a part's list is as long as the result
    parts = nodes.select("node", "vector").coalesce(spark.sparkContext.defaultParallelism)
    found = spark.createDataFrame([], "query long, node long")
    for group in range(groups):
        some = asked.filter(number == group).orderBy("query").toArrow()
        if not some.num_rows:
            continue
        ids, x = some.column("query").to_numpy(), matrix(some.column("vector"))

        def run(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, x: np.ndarray = x) -> Iterator[pa.RecordBatch]:
            row, node, near = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            worst = np.full(len(ids), -np.inf)
            for batch in batches:
                for start in range(0, batch.num_rows, SLICE):
                    part = batch.slice(start, SLICE)
                    own = part.column("node").to_numpy()
                    value = x @ matrix(part.column("vector")).T
                    i, j = np.nonzero(value >= worst[:, None])
                    row, node, near = np.append(row, i), np.append(node, own[j]), np.append(near, value[i, j])
                    order = np.lexsort((node, -near, row))
                    row, node, near = row[order], node[order], near[order]
                    rank = np.arange(len(row)) - np.searchsorted(row, row)
                    keep = rank < most
                    row, node, near, rank = row[keep], node[keep], near[keep], rank[keep]
                    worst[row[rank == most - 1]] = near[rank == most - 1]
            if len(row):
                yield pa.record_batch([pa.array(ids[row]), pa.array(node), pa.array(near)], names=["query", "node", "near"])

        lists = parts.mapInArrow(run, "query long, node long, near double")
        lists = lists.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
        found = found.union(settle(lists.select("query", "node"), "knn-scan"))
    return found


def compared_exactly(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query, node, score), the inner product of the original vectors in doubles."""
    whole = nodes.select("node", "vector")
    pairs = pairs.select("query", "node").join(whole, "node")
    pairs = pairs.join(whole.select(F.col("node").alias("query"), F.col("vector").alias("q_vector")), "query")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = np.einsum("ij,ij->i", matrix(batch.column("vector")), matrix(batch.column("q_vector")))
                yield pa.record_batch([batch.column("query"), batch.column("node"), pa.array(score)], names=["query", "node", "score"])

    return pairs.mapInArrow(exact, "query long, node long, score double")


def doubtful(seen: DataFrame, scored: DataFrame, nodes: DataFrame, k: int, beam: int) -> DataFrame:
    """Queries whose beam may have cut off one of their ``k`` best, because 8-bit values did not tell, or was not filled.

    Rounding moves each component by a uniform error of up to half a scale. What was cut off had
    an 8-bit value of at most the beam's last, and must be clearly below the exact k-th.
    """
    order = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    others = scored.filter("query <> node").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k)
    kth = others.select("query", F.col("score").alias("kth"))
    sizes = nodes.select("node", "scale", "length")
    asked = sizes.select(F.col("node").alias("query"), F.col("scale").alias("q_scale"), F.col("length").alias("q_length"))
    error = F.sqrt((F.pow(F.col("q_length") * F.col("scale"), 2) + F.pow(F.col("length") * F.col("q_scale"), 2)) / 12)
    lasts = seen.join(sizes, "node").join(asked, "query").groupBy("query").agg(
        F.count("*").alias("n"), F.min("near").alias("last"), F.max(error).alias("error")
    )
    clear = (F.col("n") >= beam) & (F.col("kth") > F.col("last") + ERRORS * F.col("error"))
    clear |= F.col("n") >= nodes.count()  # the beam holds all there are
    return lasts.join(kth, "query", "left").filter(~F.coalesce(clear, F.lit(False))).select("query")


def least_recall(found: DataFrame, truth: DataFrame, k: int) -> float:
    """Mean recall of the queries of ``found``, two standard errors below what they show; 1 if there are none."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    others = truth.filter("query <> node").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    others = others.join(found.select("query").distinct(), "query")
    both = others.join(found.select("query", "node", F.lit(1).alias("hit")), ["query", "node"], "left")
    shares = both.groupBy("query").agg((F.count("hit") / F.count("*")).alias("share"))
    mean, spread, n = shares.agg(F.avg("share"), F.stddev_pop("share"), F.count("*")).first()
    return mean - 2 * spread / n**0.5 if n else 1.0


def nearest(
    rows: DataFrame, is_query: str, *, k: int = 20, id_column: str = "vec_id", vector: str = "embedding",
    degree: int = 48, least_change: float = 0.02, most_rounds: int = 12, beam: int = 48, step: int = 16,
    recall: float = 0.9, sample: int = 256,
) -> DataFrame:
    """Per query: query_id, rank from 1, the id found under its own name, and score, the exact inner product in doubles.

    Queries are the rows for which the SQL condition ``is_query`` holds; candidates are all rows
    but the query's own. Nearest first, ties to the smaller id; all candidates if there are
    fewer than ``k``. Vectors that are null, empty, zero or hold null or non-finite components,
    and rows with a null id, take no part. A repeated id counts once per distinct vector. Other
    columns are ignored whatever their names. Empty input, or no query, gives no rows.

    Every query gets what the walk finds, with the first beam of those in ``WIDER`` whose recall,
    less two standard errors, is at least ``recall``. It is measured on ``sample`` distinct query
    vectors, those with the smallest hashes, which are compared with all vectors for that. If no beam
    finds enough, and where 8 bits leave a query's best in doubt, queries are compared with all vectors
    instead, which takes time by the number of these queries times the number of vectors.
    """
    nodes, members = nodes_of(rows, id_column, vector, k + 1)
    ids = settle(
        usable(rows.filter(is_query), id_column, vector).select(F.col("id").alias("query_id"), "vector").distinct()
        .join(nodes.select("vector", "node"), "vector").select("query_id", F.col("node").alias("query")),
        "knn-queries",
    )
    asked = ids.select("query").distinct()
    hashed = asked.join(nodes.select(F.col("node").alias("query"), F.xxhash64("vector").alias("hash")), "query")
    tested = settle(hashed.orderBy("hash", "query").limit(sample).select("query"), "knn-tested")
    wanted = 2 * k + 1
    truth = settle(compared_exactly(scan(tested, nodes, wanted), nodes), "knn-truth")
    untested = settle(asked.join(tested, "query", "left_anti"), "knn-untested")
    graph = walked_graph(nodes, degree, least_change, most_rounds)

    def walked(some: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
        """What a walk with a beam of ``width`` finds, compared exactly, and the queries that it leaves in doubt."""
        seen = walk(some, graph, width, step)
        scored = settle(compared_exactly(seen, nodes), "knn-scored")
        doubts = settle(doubtful(seen, scored, nodes, k, width), "knn-doubtful")
        return scored.join(doubts, "query", "left_anti"), doubts

    scored, rest = truth.limit(0), asked
    for width in (max(beam, wanted) * wider for wider in WIDER):
        found, doubts = walked(tested, width)
        if least_recall(found, truth, k) >= recall:
            others, more = walked(untested, width)
            scored, rest = found.union(others), doubts.union(more)
            break
    if not rest.isEmpty():
        scored = scored.union(compared_exactly(scan(rest, nodes, wanted), nodes))
    found = scored.join(members, "node").join(ids, "query").filter("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    out = found.select("query_id", rank.alias("rank"), F.col("id").alias(id_column), "score")
    return out.filter(F.col("rank") <= k)
