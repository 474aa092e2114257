"""Similarity join of documents on their word shingles, by a grouped prefix join.

Two sets of n and m shingles can only reach the similarity if their prefixes, the first quarter
of each in any order common to all, share a shingle. The order here is rare first, by the counts
of a sketch of fixed size, so shared passages come last and hardly ever take part. Documents with the
same prefix and size are collapsed into one group and only groups are joined; pairs of groups
pass filters on size and position before they are expanded to members. Members pass a filter on
parity bits, a thirty-second of their sets, and are then verified on their whole sets.

Only components are wanted, so pairs are formed in two rounds. In the first, each group is
paired with the one before it in the list of each shared shingle, and with the list's center:
the group in whose order the shingle comes first, which has the fewest rarer shingles of its
own, as an original has among its altered copies. This is linear in the lists and links large
groups of near copies. In the second, all pairs that remain between different
components are formed. No link between components is lost, and copies do not meet pair by pair.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.graph import components
from tallymark.llm.resident import release
from tallymark.llm.shared import settle

WORDS = 5
#: The similarity, 75 of 100.
SHARE, OF = 75, 100
SKETCH_BITS = 22
SLICES = 64
#: Sketches merged in one group.
FAN_IN = 64
#: Hash buckets of ids by which documents are chosen to be read again: at most this many rows are broadcast.
CHOSEN_BUCKETS = 1 << 20


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles: runs of five words, or all words if fewer."""
    words = (text or "").encode().lower().split()  # bytes: A-Z are lowered, and ASCII white space splits
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(WORDS, len(words))
    mixed = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):  # the place of a word matters: state is scrambled before the next one is added
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + each[i : i + len(mixed)]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


def sketch(docs: DataFrame) -> np.ndarray:
    """Number of documents by hash bucket of their shingles, over all documents; merged in a tree of tasks."""
    step = (1 << SKETCH_BITS) // SLICES

    def slices(counts: np.ndarray, task: int) -> pa.RecordBatch:
        data = [zlib.compress(counts[i * step : (i + 1) * step].astype(np.int64).tobytes(), 1) for i in range(SLICES)]
        columns = [pa.array(range(SLICES), pa.int32()), pa.array([task] * SLICES, pa.int64()), pa.array(data, pa.binary())]
        return pa.record_batch(columns, names=["slice", "task", "data"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                np.add.at(counts, shingles(text) >> np.uint64(64 - SKETCH_BITS), 1)
        if counts.any():
            yield slices(counts, TaskContext.get().partitionId())

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(step, np.int64)
        for data in table.column("data").to_pylist():
            total += np.frombuffer(zlib.decompress(data), np.int64)
        rows = {"slice": table.column("slice").to_pylist()[:1], "task": [table.column("task").to_pylist()[0] // FAN_IN]}
        return pa.table({**rows, "data": [zlib.compress(total.tobytes(), 1)]}, schema=pa.schema(kinds))

    kinds = [("slice", pa.int32()), ("task", pa.int64()), ("data", pa.binary())]
    schema = "slice int, task long, data binary"
    tasks = docs.rdd.getNumPartitions()
    parts = docs.select("text").mapInArrow(count, schema)
    while True:
        parts = parts.groupBy("slice", F.expr(f"task div {FAN_IN}").alias("t")).applyInArrow(merge, schema)
        tasks = -(-tasks // FAN_IN)
        if tasks <= 1:
            break
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    for row in parts.collect():  # one row a slice: a fixed size
        counts[row["slice"] * step : (row["slice"] + 1) * step] = np.frombuffer(zlib.decompress(row["data"]), np.int64)
    return counts


def rarity(counts: np.ndarray) -> np.ndarray:
    """The rank of each bucket's count, in steps far below the spread that chance gives to counts."""
    step = max(1.0, float(np.sqrt(counts.mean())) / 8)
    return np.minimum(counts / step, (1 << 16) - 1).astype(np.uint16)


def prefix(hashes: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The shingles of a set, rare first, of which similar sets share one."""
    length = len(hashes) - -(-SHARE * len(hashes) // OF) + 1 if len(hashes) else 0
    rare = np.argsort(levels[hashes >> np.uint64(64 - SKETCH_BITS)], kind="stable")
    return hashes[rare[:length]]


def parity(hashes: np.ndarray) -> bytes:
    """For each of at least twice as many hash buckets as shingles, whether an odd number of them lies there."""
    bits = max(64, 1 << (2 * len(hashes) - 1).bit_length()) if len(hashes) else 64
    counts = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits(counts.astype(np.uint8) & 1, bitorder="little").tobytes()


def most_common(n: int, x: bytes, m: int, y: bytes) -> int:
    """Shingles that sets of these sizes and parities can have in common at most: each odd bucket of one costs one."""
    p, q = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    folded = np.bitwise_xor.reduce(q.reshape(-1, len(p)), axis=0)  # buckets of the smaller are unions of the larger's
    return (n + m - int(np.bitwise_count(p ^ folded).sum())) // 2


def set_rows(bare: DataFrame, levels: np.ndarray) -> DataFrame:
    """Per document: set size, digest and parity of the set, digest of size and prefix, and the prefix."""
    shared = bare.sparkSession.sparkContext.broadcast(levels)  # 8 MB at any size of the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                some = batch.slice(start, 500)
                sets = [shingles(t) for t in some.column("text").to_pylist()]
                prefixes = [prefix(s, shared.value) for s in sets]
                digests = [blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                groups = [blake2b(p.tobytes(), digest_size=16, salt=len(s).to_bytes(8, "little")).digest()
                          for s, p in zip(sets, prefixes, strict=True)]
                values = np.concatenate(prefixes) if prefixes else np.zeros(0, np.uint64)
                offsets = np.cumsum([0, *map(len, prefixes)])
                yield pa.record_batch(
                    [
                        some.column("doc_id"),
                        some.column("text_hash"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array([parity(s) for s in sets], pa.binary()),
                        pa.array([int.from_bytes(g[:8], "little", signed=True) for g in groups], pa.int64()),
                        pa.array([int.from_bytes(g[8:], "little", signed=True) for g in groups], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64))),
                    ],
                    names=["doc_id", "text_hash", "n", "set_id", "parity", "gid", "check", "prefix"],
                )

    schema = "doc_id long, text_hash long, n long, set_id binary, parity binary, gid long, check long, prefix array<long>"
    return bare.withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, schema)


def may_reach(n: Column, i: Column, m: Column, j: Column) -> Column:
    """Whether sets of sizes n and m whose first common shingle has places i and j can be similar."""
    most = 1 + F.least(n - i, m - j) - 1
    # similar: 100 * common >= 75 * (n + m - common)
    return (F.least(n, m) * OF >= F.greatest(n, m) * SHARE) & (most * (OF + SHARE) >= (n + m) * SHARE)


def hashes_of(bare: DataFrame, wanted: DataFrame) -> DataFrame:
    """The whole sets of the wanted set_ids, from the texts of their first documents."""
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(CHOSEN_BUCKETS)).alias("bucket")
    buckets = wanted.select(F.col("first_id").alias("doc_id")).select(bucket).distinct()
    chosen = bare.withColumn("bucket", bucket).join(F.broadcast(buckets), "bucket", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                sets = [shingles(t).tobytes() for t in batch.column("text").slice(start, 500).to_pylist()]
                digests = [blake2b(s, digest_size=16).digest() for s in sets]
                yield pa.record_batch([pa.array(digests, pa.binary()), pa.array(sets, pa.binary())], names=["set_id", "hashes"])

    found = chosen.select("text").mapInArrow(run, "set_id binary, hashes binary")
    return found.join(wanted.select("set_id"), "set_id", "left_semi").dropDuplicates(["set_id"])


def plausible(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of set_ids whose sizes and parities leave the similarity possible."""
    names = ("n", "parity")
    one, two = (members.select(F.col("set_id").alias(k), *(F.col(c).alias(f"{k}_{c}") for c in names)) for k in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("a_n", "a_parity", "b_n", "b_parity")]
            keep = [(OF + SHARE) * most_common(n, x, m, y) >= SHARE * (n + m) for n, x, m, y in zip(*columns, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "a_n", "a_parity", "b_n", "b_parity").mapInArrow(run, "a binary, b binary")


def verified(bare: DataFrame, members: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) of set_ids whose whole sets are similar."""
    pairs = settle(plausible(members, pairs), f"{name}-open")
    ends = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct()
    sets = settle(hashes_of(bare, members.join(ends, "set_id")), f"{name}-sets")
    left = sets.select(F.col("set_id").alias("a"), F.col("hashes").alias("left"))
    right = sets.select(F.col("set_id").alias("b"), F.col("hashes").alias("right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, two in zip(batch.column("left"), batch.column("right"), strict=True):
                x, y = np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(two.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(OF * common >= SHARE * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    whole = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return settle(whole.mapInArrow(run, "a binary, b binary"), name)


def link_components(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: its id, n_shingles, component_id, the smallest id that links reach from it, text_hash and class_id.

    Words are what stands between ASCII white space, with A-Z lowered; sets hold distinct runs of
    five words, or all words as one run if fewer. Documents link when their sets' intersection is
    75 % of their union or more. Null and empty texts have no shingles and link with nothing, so
    their component is their own id. Repeated rows are copies. Ids are whole numbers; a null id
    is never the smallest. ``text_hash`` is the 64-bit hash of the text, which tells rows of one id
    apart; ``class_id`` names the component also where ids are null or repeated, and is null for
    documents without shingles. Other columns are ignored whatever their names. Empty input gives
    no rows.
    """
    bare = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = settle(set_rows(bare, rarity(sketch(bare))), "ngram-sets")
    sets = settle(
        rows.filter("n > 0").groupBy("set_id").agg(
            F.min("doc_id").alias("first_id"), *(F.first(c).alias(c) for c in ("n", "gid", "parity"))
        ),
        "ngram-distinct",
    )

    groups = rows.filter("n > 0").select("gid", "check", "n", "prefix").dropDuplicates(["gid", "check"])
    postings = groups.select(F.posexplode("prefix").alias("place", "shingle"), "gid", F.col("n").cast("int").alias("n"))
    order = Window.partitionBy("shingle").orderBy("n", "gid")
    ahead = F.lag(F.struct("gid", "n", "place")).over(order).alias("ahead")
    shared = postings.select("*", ahead, F.lead("gid").over(order).alias("next"))
    shared = shared.filter("ahead is not null or next is not null").drop("next")
    center = F.min(F.struct("place", "n", "gid")).over(Window.partitionBy("shingle")).alias("center")
    shared = settle(shared.select("*", center), "ngram-postings")

    # a group of several sets takes part even if it shares its prefix with no other
    several = sets.groupBy("gid").agg(F.count("*").alias("members")).filter("members > 1")
    joined = shared.select("gid").union(several.select("gid")).distinct()
    members = settle(sets.join(joined, "gid", "left_semi"), "ngram-members")

    heads = members.groupBy("gid").agg(F.min("set_id").alias("head"))
    partner = F.explode(F.array(*(F.struct(*(F.col(f"{c}.{x}").alias(x) for x in ("gid", "n", "place"))) for c in ("ahead", "center"))))
    near = shared.select("gid", "n", "place", partner.alias("with")).filter("gid <> with.gid").filter(
        may_reach(F.col("n"), F.col("place"), F.col("with.n"), F.col("with.place"))
    ).select(F.greatest("gid", "with.gid").alias("gid"), F.least("gid", "with.gid").alias("other")).distinct()
    near = near.join(heads.withColumnRenamed("head", "a"), "gid").join(
        heads.select(F.col("gid").alias("other"), F.col("head").alias("b")), "other"
    ).select("a", "b")
    inside = members.select(
        F.col("set_id").alias("a"), F.lag("set_id").over(Window.partitionBy("gid").orderBy("set_id")).alias("b")
    ).filter("b is not null")
    links = verified(bare, members, near.union(inside), "ngram-links")

    roots = components(links, "ngram-stars")
    placed = settle(
        members.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left")
        .select("gid", "set_id", F.coalesce("root", "set_id").alias("root")),
        "ngram-placed",
    )
    entries = shared.select("shingle", "gid", "n", "place").join(placed, "gid")
    mixed = entries.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    entries = settle(entries.join(mixed.select("shingle"), "shingle", "left_semi"), "ngram-open")
    one, two = entries.alias("x"), entries.alias("y")
    far = one.join(two, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.root") < F.col("y.root"))).filter(
        may_reach(F.col("x.n"), F.col("x.place"), F.col("y.n"), F.col("y.place"))
    ).select(F.col("x.set_id").alias("a"), F.col("y.set_id").alias("b"))
    same = placed.alias("x").join(
        placed.alias("y"), (F.col("x.gid") == F.col("y.gid")) & (F.col("x.root") < F.col("y.root"))
    ).select(F.col("x.set_id").alias("a"), F.col("y.set_id").alias("b"))
    more = verified(bare, members, far.union(same).distinct(), "ngram-more-links")

    stars = roots.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    final = components(stars.union(more), "ngram-components")
    named = sets.join(final.withColumnRenamed("node", "set_id"), "set_id", "left")
    named = named.select("set_id", "first_id", F.coalesce("root", "set_id").alias("root"))
    firsts = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = named.join(firsts, "root").select("set_id", "component_id", F.col("root").alias("class_id"))
    out = rows.select("doc_id", "text_hash", "n", "set_id").join(classes, "set_id", "left")
    alone = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("doc_id").alias(id_column), F.col("n").alias("n_shingles"), alone.alias("component_id"), "text_hash", "class_id"
    )
