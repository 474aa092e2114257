"""Prefix trie of conversations: which beginnings are shared, and what sharing them would save.

Every beginning of a conversation has a digest, a polynomial of its turns' hashes, so a
conversation that spans several tasks is put together from its pieces. A count-min sketch of all digests
screens them: a beginning whose estimate is one occurs in one conversation only, and so do all
longer ones, so their nodes are emitted where the rows are. Only beginnings that may be shared
are shuffled and grouped exactly. Sums over a subtree need no walk through the trie: a node's
share is booked on its smallest member, whose beginnings are just the nodes above it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.resident import release
from tallymark.llm.shared import settle, word_count

#: Digests are numbers below this prime, polynomials of turn hashes at the base.
PRIME = (1 << 127) - 1
BASE = int.from_bytes(sha256(b"prefix").digest(), "little") % PRIME
ROOT = b"\0" * 16
#: The sketch: rows of cells, cells a beginning, and the most cells a row may have (3 rows of 2^26 bits are 25 MB).
SKETCH_ROWS, CELLS_EACH, MOST_CELLS = 3, 4, 1 << 26
#: Sketches merged in one group.
FAN_IN = 64
SLICES = 64
#: Ids written out together when a node's endings are hashed.
IDS_TOGETHER = 4096
#: At most this many hot nodes are broadcast.
HOT_NODES = 10_000

RUNNING = "conv_id long, place long, key binary, words long, digest binary, prev binary, last boolean, piece int"


def turn_key(role: Column, text: Column) -> Column:
    """A hash of a turn's role and text; the length of the role keeps the two apart."""
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))


def running(turns: DataFrame, order: list[str], name: str) -> DataFrame:
    """The turns of each conversation in order: their place from 1, the digests up to and before them, and whether they are last.

    Sorted by range, so that a conversation of any length is dealt over tasks; each task numbers
    and digests its own piece, and the few conversations that lie in several pieces are corrected.
    """
    ordered = turns.repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        piece = TaskContext.get().partitionId()
        conv, place, value = None, 0, 0
        rows: list[list] = []
        for batch in batches:
            for c, key, words in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "key", "words")), strict=True):
                if c != conv:
                    if rows:
                        rows[-1][6] = True
                    conv, place, value = c, 0, 0
                before, place = value, place + 1
                value = (value * BASE + int.from_bytes(key, "little") + 1) % PRIME
                rows.append([c, place, key, words, value.to_bytes(16, "little"), before.to_bytes(16, "little"), False, piece])
            if len(rows) > 1:
                yield running_rows(rows[:-1])
                rows = rows[-1:]  # whether it is its conversation's last is not known yet
        if rows:
            rows[-1][6] = True
            yield running_rows(rows)

    local = settle(ordered.select("conv_id", "key", "words").mapInArrow(run, RUNNING), f"{name}-pieces")
    ends = local.filter("last").select("conv_id", "piece", "place", "digest")
    across = ends.groupBy("conv_id").agg(F.count("*").alias("pieces")).filter("pieces > 1").select("conv_id")
    spans = sorted(tuple(r) for r in ends.join(across, "conv_id").collect())  # two rows a task at most
    if not spans:
        return local.drop("piece")
    carries, final = {}, {}
    conv, place, value = None, 0, 0
    for c, piece, n, digest in spans:
        if c != conv:
            conv, place, value = c, 0, 0
        carries[c, piece] = place, value
        final[c] = piece
        place, value = place + n, (value * pow(BASE, n, PRIME) + int.from_bytes(digest, "little")) % PRIME

    def correct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [list(r.values()) for r in batch.to_pylist()]
            for row in rows:
                c, n, _, _, digest, prev, last, piece = row
                if (c, piece) in carries:
                    place, value = carries[c, piece]
                    row[1] = place + n
                    row[4], row[5] = (
                        ((value * pow(BASE, k, PRIME) + int.from_bytes(d, "little")) % PRIME).to_bytes(16, "little")
                        for k, d in ((n, digest), (n - 1, prev))
                    )
                    row[6] = last and final[c] == piece
            if rows:
                yield running_rows(rows)

    return settle(local.mapInArrow(correct, RUNNING), f"{name}-corrected").drop("piece")


def running_rows(rows: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.bool_(), pa.int32())
    names = [field.split()[0] for field in RUNNING.split(", ")]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def cells(digests: list[bytes], width: int) -> np.ndarray:
    """A cell of each digest in each row of the sketch; ``width`` is a power of two."""
    halves = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
    steps = np.arange(SKETCH_ROWS, dtype=np.uint64)[:, None]
    both = halves[:, 0] + steps * (halves[:, 1] | np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    both = (both ^ (both >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return ((both ^ (both >> np.uint64(32))) & np.uint64(width - 1)).astype(np.int64)


def repeated_cells(prefixes: DataFrame, width: int) -> np.ndarray:
    """A bit for each cell of the count-min sketch: whether its count over all digests is above one.

    More than that is not asked of a count, so tasks count to two, in two bits a cell.
    """
    size = SKETCH_ROWS * width // 8
    step = size // SLICES

    def parts(once: np.ndarray, twice: np.ndarray, task: int) -> pa.RecordBatch:
        data = [zlib.compress(x[i * step : (i + 1) * step].tobytes(), 1) for i in range(SLICES) for x in (once, twice)]
        columns = [pa.array(range(SLICES), pa.int32()), pa.array([task] * SLICES, pa.int64())]
        return pa.record_batch([*columns, pa.array(data[::2], pa.binary()), pa.array(data[1::2], pa.binary())], names=names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = cells(batch.column("digest").to_pylist(), width) + np.arange(SKETCH_ROWS)[:, None] * width
            own, times = np.unique(flat, return_counts=True)
            byte, bit = own >> 3, (1 << (own & 7)).astype(np.uint8)
            again = (times > 1) | (once[byte] & bit > 0)
            np.bitwise_or.at(twice, byte[again], bit[again])
            np.bitwise_or.at(once, byte, bit)
        if once.any():
            yield parts(once, twice, TaskContext.get().partitionId())

    def merge(table: pa.Table) -> pa.Table:
        once, twice = np.zeros(step, np.uint8), np.zeros(step, np.uint8)
        for a, b in zip(table.column("once").to_pylist(), table.column("twice").to_pylist(), strict=True):
            a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
            twice |= b | once & a
            once |= a
        row = [[table.column("slice")[0].as_py()], [table.column("task")[0].as_py() // FAN_IN]]
        return pa.table([*row, [zlib.compress(once.tobytes(), 1)], [zlib.compress(twice.tobytes(), 1)]], schema=pa.schema(kinds))

    names = ["slice", "task", "once", "twice"]
    kinds = list(zip(names, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True))
    schema = "slice int, task long, once binary, twice binary"
    tasks = prefixes.rdd.getNumPartitions()
    found = prefixes.select("digest").mapInArrow(count, schema)
    while True:
        found = found.groupBy("slice", F.expr(f"task div {FAN_IN}").alias("t")).applyInArrow(merge, schema)
        tasks = -(-tasks // FAN_IN)
        if tasks <= 1:
            break
    out = np.zeros(size, np.uint8)
    for row in found.select("slice", "twice").collect():  # one row a slice: a fixed size
        out[row["slice"] * step : (row["slice"] + 1) * step] = np.frombuffer(zlib.decompress(row["twice"]), np.uint8)
    return out


def screened(prefixes: DataFrame, cells_each: int = CELLS_EACH) -> DataFrame:
    """The prefixes with ``shared``, false if they are proven to occur once, and ``open``, the same of the one before."""
    wanted = cells_each * max(prefixes.count(), 1)
    width = min(max(1 << 9, 1 << (wanted - 1).bit_length()), MOST_CELLS)
    sketch = prefixes.sparkSession.sparkContext.broadcast(repeated_cells(prefixes, width))  # 25 MB at most

    def several(digests: list[bytes]) -> np.ndarray:
        flat = cells(digests, width) + np.arange(SKETCH_ROWS)[:, None] * width
        estimate = (sketch.value[flat >> 3] >> (flat & 7).astype(np.uint8)) & 1
        return estimate.all(0) | np.array([d == ROOT for d in digests], bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                open_ = several(batch.column("prev").to_pylist())
                shared = several(batch.column("digest").to_pylist()) & open_
                yield pa.record_batch([*batch.columns, pa.array(shared), pa.array(open_)], names=[*batch.schema.names, "shared", "open"])

    bare = prefixes.select("conv_id", "place", "words", "digest", "prev", "last")
    schema = "conv_id long, place long, words long, digest binary, prev binary, last boolean, shared boolean, open boolean"
    return bare.mapInArrow(run, schema)


def endings(rows: DataFrame) -> DataFrame:
    """(digest, ends_sha256) of the comma-joined ids, ascending, of each digest's rows.

    Ids are sorted by range and joined in chunks by many tasks; one task then hashes a digest's
    chunks in a row, as SHA-256 has to be, without holding them.
    """

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, ids = None, []
        for batch in batches:
            out = []
            for d, c in zip(batch.column("digest").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if ids and (d != digest or len(ids) == IDS_TOGETHER):
                    out.append((digest, ids[0], ",".join(map(str, ids))))
                    ids = []
                digest = d
                ids.append(c)
            if out:
                yield pa.record_batch([pa.array(c) for c in zip(*out, strict=True)], names=["digest", "first", "ids"])
        if ids:
            yield pa.record_batch([pa.array([digest]), pa.array([ids[0]]), pa.array([",".join(map(str, ids))])], names=["digest", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state = None, None
        for batch in batches:
            out = []
            for d, ids in zip(batch.column("digest").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if d == own:
                    state.update(b"," + ids.encode())
                    continue
                if own is not None:
                    out.append((own, state.hexdigest()))
                own, state = d, sha256(ids.encode())
            if out:
                yield pa.record_batch([pa.array(c) for c in zip(*out, strict=True)], names=["digest", "ends_sha256"])
        if own is not None:
            yield pa.record_batch([pa.array([own]), pa.array([state.hexdigest()])], names=["digest", "ends_sha256"])

    ordered = rows.select("digest", "conv_id").repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id")
    chunks = ordered.mapInArrow(chunk, "digest binary, first long, ids string")
    together = chunks.repartition("digest").sortWithinPartitions("digest", "first")
    return together.select("digest", "ids").mapInArrow(digest, "digest binary, ends_sha256 string")


def with_parent(rows: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """The rows with ``parent_conv_id``, the conv_id of the node whose digest is their ``prev``; their own if it is no node.

    Nodes with more children than the share of ``most`` are broadcast, so that their children
    are not gathered in one task.
    """
    hot = nodes.filter(F.col("n_children") > most).select(F.col("digest").alias("prev"), F.col("conv_id").alias("hot"))
    cold = nodes.select(F.col("digest").alias("key"), F.col("conv_id").alias("cold"))
    found = rows.join(F.broadcast(hot), "prev", "left")  # at most HOT_NODES rows, as all rows are children
    found = found.withColumn("key", F.when(F.col("hot").isNull(), F.col("prev")).otherwise(F.col("digest")))
    found = found.join(cold, "key", "left")
    parent = F.coalesce("hot", "cold", "conv_id")
    return found.withColumn("parent_conv_id", F.when(F.col("depth") > 0, parent)).drop("hot", "cold", "key")


def trie(turns: DataFrame, conversations: DataFrame, order: list[str], name: str = "trie") -> DataFrame:
    """The nodes of the trie of all conversations, a row per distinct sequence of first turns.

    ``conversations`` has the conv_id of every conversation, also of those without turns;
    ``turns`` has conv_id, key (a hash of what a turn is), words and the columns of ``order``.
    Per node: conv_id, the smallest of its members, the conversations that begin with it; depth;
    parent_conv_id, null at the root; n_convs, its members; n_children; n_leaves, the childless
    nodes in its subtree, itself included; saved_tokens, summed over its subtree: the words of a
    node's last turn times the members beyond the first; ends_sha256, a digest of the ids of the
    members that end there. No conversations give no nodes.
    """
    prefixes = running(turns, order, f"{name}-prefixes")
    rows = settle(screened(prefixes).withColumnRenamed("place", "depth"), f"{name}-screened")

    # the beginnings that may be shared: of all conversations the root, and what the sketch leaves open
    started = rows.filter("depth = 1").select("conv_id", F.lit(False).alias("last"))
    roots = conversations.select("conv_id").join(started, "conv_id", "left").select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), F.lit(ROOT).alias("digest"),
        F.lit(None).cast("binary").alias("prev"), F.coalesce("last", F.lit(True)).alias("last"),
    )
    shared = settle(rows.filter("shared").select(roots.columns).union(roots), f"{name}-shared")
    alone = rows.filter("not shared")

    nodes = shared.groupBy("digest").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("prev").alias("prev"),
        F.count("*").alias("n_convs"), F.min("words").alias("words"),
    )
    nodes = settle(nodes, f"{name}-grouped")
    children = nodes.select("prev").union(alone.filter("open").select("prev")).filter("prev is not null")
    children = children.groupBy("prev").agg(F.count("*").alias("n_children")).withColumnRenamed("prev", "digest")
    nodes = nodes.join(children, "digest", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    nodes = settle(nodes, f"{name}-nodes")

    # what each node adds to those above it, booked on its smallest member, summed from the end of that conversation on
    added = nodes.select(
        "conv_id", "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaves")
    ).filter("saved > 0 or leaves > 0")
    tails = alone.filter("last").select("conv_id", "depth", F.lit(0).cast("long").alias("saved"), F.lit(1).cast("long").alias("leaves"))
    none = F.lit(None).cast("binary").alias("digest")
    booked = added.union(tails).select("*", none).union(
        shared.select("conv_id", "depth", F.lit(0).cast("long"), F.lit(0).cast("long"), "digest")
    )
    below = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = booked.select("digest", F.sum("saved").over(below).alias("saved"), F.sum("leaves").over(below).alias("leaves"))
    sums = sums.filter("digest is not null").groupBy("digest").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))

    ends = endings(shared.filter("last"))
    heads = alone.filter("open")
    most = max(1000, -(-(nodes.count() + heads.count()) // HOT_NODES))
    empty = F.sha2(F.lit("").cast("binary"), 256)
    exact = with_parent(nodes, nodes, most).join(sums, "digest").join(ends, "digest", "left")
    exact = exact.select(*OUT[:5], "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))
    inner = alone.filter("not open").withColumn("parent_conv_id", F.col("conv_id"))
    ended = F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(empty)
    single = with_parent(heads, nodes, most).select(inner.columns).union(inner).select(
        "conv_id", "depth", "parent_conv_id", F.lit(1).cast("long").alias("n_convs"), (~F.col("last")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), ended.alias("ends_sha256"),
    )
    return exact.union(single)


OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, key, words) of a table of turns; null roles and texts are empty, null conv_ids left out."""
    whole = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text"))
    ).filter("conv_id is not null")
    return whole.select("*", turn_key(F.col("role"), F.col("text")).alias("key"), word_count("text").alias("words"))


def branched(conversations: DataFrame, group: int = 20, most: int = 3, name: str = "branched") -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) in which conversations begin with turns of their group's first one.

    Turns are ordered by ``turn``, null first, those of equal number by role and text. The first
    h turns of conversation c are replaced by those of conversation c - c % group, as many as there are, h being
    the CRC-32 of c's digits modulo ``most`` + 1. The turns' order is ``part``, ``place``.
    """
    turns = running(plain_turns(conversations), ["turn", "role", "text"], name).select("conv_id", "place", "key", "words")
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    ids = settle(turns.filter("place = 1").select("conv_id"), f"{name}-ids")
    heads = turns.filter(F.col("place") <= most).withColumnRenamed("conv_id", "base")
    first = ids.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(heads, "base").filter(F.col("place") <= taken)
    own = turns.filter(F.col("place") > taken)
    parts = [x.select("conv_id", F.lit(i).alias("part"), "place", "key", "words") for i, x in enumerate((first, own))]
    return parts[0].union(parts[1]), ids
