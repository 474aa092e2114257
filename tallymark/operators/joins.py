"""Full outer join of two prepared sides on null-safe keys, hot keys included.

Plain case: one sort-merge full outer join, one exchange per side. Adaptive
skew handling does not cover full outer joins, so a key that holds a large share
of the rows would land in one task. ``find_hot_keys`` spots such keys with a
frequent-items sketch (a bounded result, whatever the data size) and the join
then takes their rows out:

* equal rows of a hot key are first folded into one row with a count, which
  combines map-side and collapses groups of copies before anything is shuffled;
* the folded rows of both sides meet in a grid of cells, each source row in one
  grid row and each target row in one grid column, so the work of one key is
  spread and every pair is met exactly once;
* rows of hot keys that one side lacks need no join, nor any shuffle.

Cells are chosen by a hash of the row itself, so a task that is run again after
an executor was lost puts its rows in the same cells.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import takewhile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions import values as V
from tallymark.operators.folding import tasks_for

SOURCE_PRESENT = "__source_present"
TARGET_PRESENT = "__target_present"
WEIGHT = "__weight"

# A key is hot when one task would get too many rows or pairs of it: from this
# many rows on, provided they are at least this share of the side. So there are
# at most 1 / HOT_SHARE hot keys per side, whatever the size of the data.
HOT_ROWS = 20_000
HOT_SHARE = 1e-5
# Keys are dealt to this many sketches, each merged by its own task. A sketch of
# that many items finds every key above about 1 / (0.75 * items) of the rows it
# sees; together that is 1 / 196608 of a side, well below HOT_SHARE.
SKETCHES = 64
SKETCH_ITEMS = 4096
SKETCH_TOP = 2048


# The sketches look at a share of the rows in which the smallest hot key still has
# this many rows on average, and take any key with half as many. Missing a key by
# chance is out of the question, and would cost time only: the join is exact
# whichever keys are treated as hot.
SAMPLED_ROWS = 200


# A folded row stands for at most this many equal rows, so a pair of two for at most its square.
FOLDED_ROWS = 1024
# A cell gets rows for about this many pairs, but at least this many rows of a side.
CELL_PAIRS = 25_000_000
CELL_ROWS = 5000
# Pairs of hot keys that a task forms, and the most tasks that share them.
TASK_PAIRS = 4_000_000
MOST_TASKS = 10_000


@dataclass(frozen=True)
class HotKey:
    """A key value (as its tag) and the exact row counts of both sides."""

    tag: str
    source_rows: int
    target_rows: int

    def meets(self, null_keys: str) -> bool:
        """Whether rows of this key join at all."""
        if null_keys == "differ" and "n" in takewhile(str.isalpha, self.tag):
            return False
        return self.source_rows > 0 and self.target_rows > 0


class HotKeys(list[HotKey]):
    """The hot keys, and about how many rows the longer side has."""

    rows: int = 0


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def key_tag(names: Sequence[str]) -> Column:
    """One text per key value: a mark per part saying whether it is null, then the parts with their lengths."""
    texts = [_col(n).cast("string") for n in names]
    marks = [F.when(t.isNull(), "n").otherwise("v") for t in texts]
    parts = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("")) for t in texts]
    return F.concat(*marks, *parts)


def align_key_types(source: DataFrame, target: DataFrame, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Bring each key to one type on both sides, so equal keys hash and render alike."""
    for name in names:
        s, t = source.schema[name].dataType, target.schema[name].dataType
        if isinstance(s, T.BooleanType) != isinstance(t, T.BooleanType):  # flags are the numbers 1 and 0
            if isinstance(s, T.BooleanType):
                source, s = source.withColumn(name, _col(name).cast("int")), T.IntegerType()
            else:
                target, t = target.withColumn(name, _col(name).cast("int")), T.IntegerType()
        common = s if s == t else source.select(_col(name)).union(target.select(_col(name))).schema[0].dataType
        if s == t and not V.is_floating(common):
            continue
        key = _col(name).cast(common)
        if V.is_floating(common):
            key = key + F.lit(0.0).cast(common)  # one zero only
        source, target = source.withColumn(name, key), target.withColumn(name, key)
    return source, target


def find_hot_keys(
    source: DataFrame,
    target: DataFrame,
    names: Sequence[str],
    *,
    share: float = HOT_SHARE,
    min_rows: int = HOT_ROWS,
) -> HotKeys:
    """Keys holding at least ``min_rows`` rows and at least ``share`` of the rows of a side.

    Two light passes over the key columns only. The first sketches a sample and returns at most
    ``SKETCHES * SKETCH_TOP`` candidates per side, the second counts just these
    exactly, so what reaches the driver has a fixed bound. Without candidates
    there is no second pass.
    """
    if not HOT_SHARE <= share <= 1:
        raise ValueError(f"share must lie between {HOT_SHARE} and 1, got {share}")
    source, target = align_key_types(source, target, names)
    tagged = [side.select(key_tag(names).alias("tag")) for side in (source, target)]
    both = tagged[0].withColumn("side", F.lit(0)).unionByName(tagged[1].withColumn("side", F.lit(1)))
    fraction = min(1.0, SAMPLED_ROWS / min_rows)
    least = min_rows if fraction == 1 else SAMPLED_ROWS // 2
    found = (
        (both if fraction == 1 else both.sample(fraction, seed=0))
        .groupBy("side", F.pmod(F.xxhash64("tag"), F.lit(SKETCHES)).alias("sketch"))
        .agg(F.count(F.lit(1)).alias("rows"), F.expr(f"approx_top_k(tag, {SKETCH_TOP}, {SKETCH_ITEMS})").alias("top"))
        .withColumn("top", F.filter("top", lambda item: item["count"] >= F.lit(least)))
        .collect()  # SKETCHES rows per side, of at most SKETCH_TOP items
    )
    candidates: set[str] = set()
    hot = HotKeys()
    for side in (0, 1):
        own = [row for row in found if row["side"] == side]
        hot.rows = max(hot.rows, round(sum(row["rows"] for row in own) / fraction))
        seen = share * sum(row["rows"] for row in own)
        floor = max(least, seen if fraction == 1 else seen / 2)
        # a sketch's estimate is never below the count it has seen
        candidates |= {item["item"] for row in own for item in row["top"] if item["count"] >= floor}
    if not candidates:
        return hot
    wanted = source.sparkSession.createDataFrame([(c,) for c in sorted(candidates)], "tag string")
    counted = both.join(F.broadcast(wanted), "tag", "left_semi").groupBy("tag")
    counted = counted.agg(F.count_if(F.col("side") == 0).alias("s"), F.count_if(F.col("side") == 1).alias("t"))
    keys = [HotKey(row["tag"], row["s"], row["t"]) for row in counted.collect()]  # no more rows than candidates
    hot += [key for key in keys if max(key.source_rows, key.target_rows) >= min_rows]
    return hot


def _on_keys(names: Sequence[str], left: str, right: str, null_keys: str) -> Column:
    def pair(name: str) -> Column:
        s, t = F.col(f"{left}.`{name}`"), F.col(f"{right}.`{name}`")
        return s.eqNullSafe(t) if null_keys == "match" else s == t

    return reduce(lambda a, b: a & b, [pair(n) for n in names])


def _merge_keys(joined: DataFrame, names: Sequence[str], s_cols: Sequence[str], t_cols: Sequence[str]) -> DataFrame:
    keys = [F.coalesce(F.col(f"s.`{n}`"), F.col(f"t.`{n}`")).alias(n) for n in names]
    return joined.select(
        *keys, *[F.col(f"s.`{c}`").alias(c) for c in s_cols], *[F.col(f"t.`{c}`").alias(c) for c in t_cols]
    )


def _plain_join(s: DataFrame, t: DataFrame, names: Sequence[str], null_keys: str, rows: int = 0) -> DataFrame:
    """Full outer join; sides of many ``rows`` are dealt over tasks of a bounded size."""
    s_cols = [c for c in s.columns if c not in names]
    t_cols = [c for c in t.columns if c not in names]
    tasks = tasks_for(rows)
    if tasks == 1 or null_keys == "differ":  # bucketed tables stay as they are
        joined = s.alias("s").join(t.alias("t"), _on_keys(names, "s", "t", null_keys), "full_outer")
        return _merge_keys(joined, names, s_cols, t_cols)
    dealt = []
    for side, mark in ((s, "s"), (t, "t")):
        parts = {f"__{mark}_part{i}": p for i, p in enumerate(_key_parts(side, names, null_keys))}
        dealt.append(side.withColumns(parts).repartition(tasks, *parts).alias(mark))
    same = [F.col(f"__s_part{i}") == F.col(f"__t_part{i}") for i in range(2 * len(names))]
    return _merge_keys(dealt[0].join(dealt[1], reduce(lambda a, b: a & b, same), "full_outer"), names, s_cols, t_cols)


def hot_tags(side: DataFrame, hot: Sequence[HotKey]) -> DataFrame:
    """The tags of hot keys; their number has a fixed bound, so they can be broadcast."""
    return F.broadcast(side.sparkSession.createDataFrame([(key.tag,) for key in hot], "__tag string"))


def without_hot(side: DataFrame, names: Sequence[str], hot: Sequence[HotKey]) -> DataFrame:
    """Rows whose key is not hot."""
    return side.withColumn("__tag", key_tag(names)).join(hot_tags(side, hot), "__tag", "left_anti").drop("__tag")


def only_hot(side: DataFrame, names: Sequence[str], hot: Sequence[HotKey]) -> DataFrame:
    """Rows whose key is hot, with its tag as ``__tag``."""
    return side.withColumn("__tag", key_tag(names)).join(hot_tags(side, hot), "__tag", "left_semi")


def _hot_rows(side: DataFrame, names: Sequence[str], table: DataFrame, folded: bool) -> DataFrame:
    """Rows of hot keys, equal rows folded into rows with a count, and their cell hash.

    Unless they stay ``folded``, counts are bounded: the parts of many equal rows have hashes of
    their own, so their pairs are spread over cells too.
    """
    tagged = side.withColumn("__tag", key_tag(names))
    every = [_col(c) for c in (*tagged.columns, *table.columns[1:])]
    counted = tagged.join(F.broadcast(table), "__tag").groupBy(*every).agg(F.count(F.lit(1)).alias(WEIGHT))
    if folded:
        return counted.withColumn("__hash", F.xxhash64(*[_col(c) for c in side.columns]))
    parts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"({WEIGHT} - 1) div {FOLDED_ROWS}")))
    dealt = counted.withColumn("__part", parts)
    dealt = dealt.withColumn(WEIGHT, F.least(F.lit(FOLDED_ROWS).cast("bigint"), F.col(WEIGHT) - F.col("__part") * FOLDED_ROWS))
    return dealt.withColumn("__hash", F.xxhash64(*[_col(c) for c in side.columns], "__part")).drop("__part")


def _cell(splits: str) -> Column:
    return F.pmod(F.col("__hash"), F.col(splits)).cast("int")


def _every(splits: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(splits) - 1))


def outer_join(
    source: DataFrame,
    target: DataFrame,
    names: Sequence[str],
    *,
    null_keys: str = "match",
    hot: Sequence[HotKey] = (),
    rows_per_cell: int = 500_000,
    folded: bool = False,
) -> DataFrame:
    """Full outer join; columns are the keys, then source's, then target's, plus presence flags.

    ``null_keys="match"`` joins missing keys to missing keys. ``"differ"`` never
    does; use it for keys known to be filled, because a plain equality lets
    bucketed tables join without an exchange.

    With hot keys that both sides have, the result carries ``__weight``: how often the row counts.
    With ``folded`` all pairs of equal rows are one row, whose weight has no bound: to be counted, not unfolded.
    """
    if null_keys not in ("match", "differ"):
        raise ValueError(f"null_keys must be 'match' or 'differ', got {null_keys!r}")
    source, target = align_key_types(source, target, names)
    s = source.withColumn(SOURCE_PRESENT, F.lit(True))
    t = target.withColumn(TARGET_PRESENT, F.lit(True))
    rows = getattr(hot, "rows", 0)
    if not hot:
        return _plain_join(s, t, names, null_keys, rows)

    meeting = [key for key in hot if key.meets(null_keys)]
    apart = [key for key in hot if not key.meets(null_keys)]
    parts = [_plain_join(*[without_hot(side, names, hot) for side in (s, t)], names, null_keys, rows)]
    # rows of a hot key the other side lacks go straight to the result
    if any(key.source_rows for key in apart):
        parts.append(only_hot(s, names, apart).drop("__tag"))
    if any(key.target_rows for key in apart):
        parts.append(only_hot(t, names, apart).drop("__tag"))
    if meeting:
        parts = [part.withColumn(WEIGHT, F.lit(1).cast("bigint")) for part in parts]
        parts.append(_grid_join(s, t, names, meeting, rows_per_cell, folded))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _grid_join(
    s: DataFrame, t: DataFrame, names: Sequence[str], meeting: Sequence[HotKey], rows_per_cell: int, folded: bool
) -> DataFrame:
    """Pairs of the hot keys both sides have: folded rows, met cell by cell, each pair with its weight.

    Folded rows are few bytes for many pairs, so cells are dealt by the number of pairs; merged by
    their size they would all come to one task.
    """
    def splits(own: int, other: int) -> int:
        return max(1, math.ceil(own / min(rows_per_cell, max(CELL_ROWS, CELL_PAIRS // other))))

    rows = [
        (key.tag, splits(key.source_rows, key.target_rows), splits(key.target_rows, key.source_rows)) for key in meeting
    ]
    # one row per hot key, so bounded
    table = s.sparkSession.createDataFrame(rows, "__tag string, __s_splits int, __t_splits int")
    s_hot, t_hot = _hot_rows(s, names, table, folded), _hot_rows(t, names, table, folded)
    grid_s = s_hot.withColumn("__i", _cell("__s_splits")).withColumn("__j", _every("__t_splits"))
    grid_t = t_hot.withColumn("__j", _cell("__t_splits")).withColumn("__i", _every("__s_splits"))
    pairs = sum(key.source_rows * key.target_rows for key in meeting)
    tasks = min(MOST_TASKS, sum(i * j for _, i, j in rows), math.ceil(pairs / TASK_PAIRS))
    if tasks > 1 and not folded:
        grid_s, grid_t = [side.repartition(tasks, "__tag", "__i", "__j") for side in (grid_s, grid_t)]
    same_cell = reduce(lambda a, b: a & b, [F.col(f"s.{c}") == F.col(f"t.{c}") for c in ("__tag", "__i", "__j")])
    met = grid_s.alias("s").join(grid_t.alias("t"), same_cell, "inner")
    return met.select(
        *[F.col(f"s.`{c}`").alias(c) for c in s.columns],
        *[F.col(f"t.`{c}`").alias(c) for c in t.columns if c not in names],
        (F.col(f"s.{WEIGHT}") * F.col(f"t.{WEIGHT}")).alias(WEIGHT),
    )


def _filled(col: Column, dtype: T.DataType) -> Column:
    """The key with a stand-in for NULL; used together with the null test."""
    kind = V.family(dtype)
    if kind == V.DATETIME:
        stand_in = F.lit("1970-01-01").cast(dtype)
    else:
        stand_in = F.lit("" if kind == V.TEXT else 0).cast(dtype)
    return F.coalesce(col, stand_in)


def _key_parts(df: DataFrame, names: Sequence[str], null_keys: str) -> list[Column]:
    """What equal keys have in common: the keys, or each with a stand-in for NULL and the null test."""
    columns = [_col(n) for n in names]
    if null_keys == "differ":
        return columns
    types = [df.schema[n].dataType for n in names]
    return [p for c, dtype in zip(columns, types) for p in (_filled(c, dtype), c.isNull())]


def anti_join(own: DataFrame, other: DataFrame, names: Sequence[str], *, null_keys: str = "match") -> DataFrame:
    """Rows of ``own`` whose key ``other`` lacks.

    The other side's keys are reduced to distinct ones first, which combines
    map-side, under the very expressions the join hashes on; so repeated keys do
    not travel, and the reduced keys are not shuffled a second time.
    """
    own, other = align_key_types(own, other.select(*[_col(n) for n in names]), names)
    parts = _key_parts(own, names, null_keys)
    probe = own.withColumns({f"__p{i}": p for i, p in enumerate(parts)})
    taken = other.groupBy(*[p.alias(f"__t{i}") for i, p in enumerate(_key_parts(other, names, null_keys))])
    taken = taken.agg(F.lit(1).alias("__one"))
    same = [F.col(f"__p{i}") == F.col(f"__t{i}") for i in range(len(parts))]
    lonely = probe.join(taken, reduce(lambda a, b: a & b, same), "left_anti")
    return lonely.select(*[_col(c) for c in own.columns])


def unfold(df: DataFrame) -> DataFrame:
    """One row per counted pair: pairs of many copies as runs of ``FOLDED_ROWS``, then the copies of each run.

    Exploded one within the other, all copies of a pair would be held before the first is passed on.
    The union comes between, so a task holds the copies of one run at a time.
    """
    if WEIGHT not in df.columns:
        return df
    few, many = df.filter(F.col(WEIGHT) <= FOLDED_ROWS), df.filter(F.col(WEIGHT) > FOLDED_ROWS)
    runs = F.sequence(F.lit(0).cast("bigint"), F.expr(f"({WEIGHT} - 1) div {FOLDED_ROWS}"))
    rest = F.least(F.lit(FOLDED_ROWS).cast("bigint"), F.col(WEIGHT) - F.col("__run") * FOLDED_ROWS)
    parts = few.unionByName(many.withColumn("__run", F.explode(runs)).withColumn(WEIGHT, rest).drop("__run"))
    return parts.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(WEIGHT)))).drop("__copy", WEIGHT)


def weighted_count(df: DataFrame, condition: Column | None = None) -> Column:
    """Count of rows (meeting a condition), each as often as it counts."""
    if WEIGHT not in df.columns:
        return F.count(F.lit(1)) if condition is None else F.count_if(condition)
    weight = F.col(WEIGHT) if condition is None else F.when(condition, F.col(WEIGHT)).otherwise(F.lit(0))
    return F.coalesce(F.sum(weight), F.lit(0)).cast("bigint")
