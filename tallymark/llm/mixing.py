"""Mixing sources to target weights by hash thresholds.

Every document has a fixed hash. A source takes all documents whose hash is at most its
threshold, so a larger budget takes a superset and reruns agree. Thresholds come from
histograms: sizes are summed by source and hash bucket, the bucket in which the running sum
crosses the budget is found, and only the documents of that bucket are looked at more closely,
first by a finer histogram and then one by one. No documents are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.shared import settle, word_count

HASH_BITS = 60
#: Hash bits that each histogram resolves; two histograms leave one document in 2**24 to look at.
LEVEL_BITS = 12
LEVELS = 2


def document_hash(id_column: str, text: str, seed: str) -> Column:
    """60 bits of the id's digest; rows without an id go by their text. Equal hashes go together."""
    key = F.coalesce(F.col(id_column).cast("string"), F.col(text), F.lit(""))
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), key)), 1, HASH_BITS // 4), 16, 10).cast("long")


def numbered(sources: DataFrame) -> DataFrame:
    """Sources with their number in code point order, null last, without gathering them in one task."""
    order = [F.col("source").isNull(), F.col("source")]
    dealt = sources.repartitionByRange(*order).sortWithinPartitions(*order)
    # written, so that both uses below see the same partitions
    dealt = settle(dealt.withColumn("at", F.monotonically_increasing_id()), "mix-sources")
    part = F.shiftright("at", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    firsts = (
        dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
        .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    )
    within = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = dealt.withColumn("part", part).join(F.broadcast(firsts), "part")
    return numbered.select("source", "source_size", (F.col("first") + within).alias("number"))


def targets(sources: DataFrame, weights: Sequence[float], share: float, limit: float) -> DataFrame:
    """Adds each source's target: its weight's part of ``share`` times all sizes, at most ``limit`` times its size.

    What sources beyond their limit cannot take is shared anew by weight. Each round is one
    aggregate over the sources; rounds end when no further source meets its limit.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    weighed = settle(numbered(sources).select("source", "source_size", weight.alias("weight")), "mix-weights")
    whole = weighed.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    if not whole["size"]:
        return weighed.withColumn("target", F.lit(0.0))
    level, capped = share * whole["size"] / whole["weight"], -1
    while True:
        full = F.col("source_size") * limit < F.col("weight") * level
        now = weighed.agg(
            F.count_if(full).alias("n"),
            F.sum(F.when(full, F.col("source_size"))).alias("size"),
            F.sum(F.when(~full, F.col("weight"))).alias("weight"),
        ).first()
        if now["n"] == capped or not now["weight"]:
            break
        capped = now["n"]
        level = (share * whole["size"] - limit * (now["size"] or 0)) / now["weight"]
    return weighed.withColumn("target", F.when(full, F.col("source_size") * limit).otherwise(F.col("weight") * level))


def thresholds(sized: DataFrame, aims: DataFrame) -> DataFrame:
    """Per source: copies of every document, and the hash up to which documents are taken once more.

    The sum of sizes up to the threshold is the one nearest to what remains of the target.
    """
    base = F.when(F.col("target") >= F.col("source_size"), 1).otherwise(0)
    open_ = aims.select(
        "source", "source_size", "target", base.alias("base"),
        (F.col("target") - base * F.col("source_size")).alias("budget"), F.lit(0).cast("long").alias("prefix"),
    )
    rows = sized.select("source", "size", "hash")
    for level in range(LEVELS):
        shift = HASH_BITS - LEVEL_BITS * (level + 1)
        bucket = F.shiftright("hash", shift)
        sums = rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("size"))
        running = Window.partitionBy("name").orderBy("bucket")  # at most 4096 buckets
        place = sums.join(open_.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name")))
        place = place.withColumn("upto", F.sum("size").over(running)).filter(F.col("upto") > F.col("budget"))
        crossed = place.groupBy("name").agg(F.min(F.struct("bucket", "size", "upto")).alias("c"))
        crossed = crossed.select(
            "name", F.col("c.bucket").alias("prefix"), (F.col("c.upto") - F.col("c.size")).alias("below")
        )
        found = open_.drop("prefix").join(crossed, F.col("source").eqNullSafe(F.col("name")), "left").drop("name")
        # where nothing crosses, all is taken: the prefix beyond all others
        open_ = settle(
            found.withColumns({
                "prefix": F.coalesce("prefix", F.lit(1 << LEVEL_BITS * (level + 1))),
                "budget": F.col("budget") - F.coalesce("below", F.lit(0)),
            }).drop("below"),
            "mix-boundaries",
        )
        inside = open_.select(F.col("source").alias("name"), "prefix")
        rows = rows.join(
            inside, F.col("source").eqNullSafe(F.col("name")) & (bucket == F.col("prefix")), "left_semi"
        )
    last = rows.groupBy("source", "hash").agg(F.sum("size").alias("size"))
    last = last.join(
        open_.select(F.col("source").alias("name"), "budget"), F.col("source").eqNullSafe(F.col("name"))
    )
    upto = F.sum("size").over(Window.partitionBy("name").orderBy("hash"))
    over, under = F.col("upto") - F.col("budget"), F.col("budget") - (F.col("upto") - F.col("size"))
    taken = last.withColumn("upto", upto).filter((over <= 0) | ((under > 0) & (over < under)))
    ends = taken.groupBy("name").agg(F.max("hash").alias("end"))
    shift = HASH_BITS - LEVEL_BITS * LEVELS
    start = F.shiftleft("prefix", shift) - 1  # all of the buckets below
    joined = open_.join(ends, F.col("source").eqNullSafe(F.col("name")), "left")
    return settle(
        joined.select("source", "source_size", "target", "base", F.coalesce("end", start).alias("threshold")), "mix-thresholds"
    )


def plan(docs: DataFrame, weights: Sequence[float], share: float, limit: float, seed: str, id_column: str) -> DataFrame:
    """The thresholds of all sources of ``docs``, which has columns of that id, ``source`` and ``text``."""
    sized = settle(
        docs.select("source", word_count().alias("size"), document_hash(id_column, "text", seed).alias("hash")), "mix-sizes"
    )
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    return thresholds(sized, targets(sources, weights, share, limit))


def mix(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, limit: float = 2.0, *,
    seed: str = "", id_column: str = "doc_id",
) -> DataFrame:
    """Per document: its id, size in words, source_size, target of its source, copies and taken (words, repeats counted).

    Sources in code point order, null last, weigh ``weights`` in turn and share ``share`` times
    the sum of sizes; no source takes more than ``limit``, at most 2, times its size. A null text
    has size 0; a null id is hashed by its text; rows with equal ids are taken together. Other
    columns are ignored whatever their names. Empty input gives no rows.
    """
    bare = docs.select(F.col(id_column).alias(id_column), "source", "text")
    found = plan(bare, weights, share, limit, seed, id_column)
    sized = bare.select(
        id_column, "source", word_count().alias("size"), document_hash(id_column, "text", seed).alias("hash")
    )
    joined = sized.join(found.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name")))
    copies = F.col("base") + (F.col("hash") <= F.col("threshold")).cast("int")
    return joined.select(
        id_column, "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def mixed(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, limit: float = 2.0, *,
    seed: str = "", id_column: str = "doc_id",
) -> DataFrame:
    """The rows of ``docs`` as often as ``mix`` takes them, with all their columns."""
    found = plan(docs, weights, share, limit, seed, id_column)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    packed = docs.select(row, F.col("source").alias("name"), document_hash(id_column, "text", seed).alias("hash"))
    joined = packed.join(found, F.col("source").eqNullSafe(F.col("name")))
    copies = F.col("base") + (F.col("hash") <= F.col("threshold")).cast("int")
    return joined.select("row", F.explode(F.array_repeat(F.lit(0), copies))).select("row.*")
