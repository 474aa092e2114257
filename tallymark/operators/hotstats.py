"""Statistics of hot keys without forming their pairs.

A key with m source and n target rows stands for m * n pairs. What the
statistics need of them follows from counts of equal values:

* pairs, comparable pairs and unreadable numbers from row and null counts;
* exact matches from an equi-join of value counts;
* matches within a tolerance from ranks: both sides' values are sorted together, and the
  partners of a value are the target rows up to its upper bound less those below its lower
  one, so the work is linear however wide the tolerance is;
* fully matching pairs from ranks too, among pairs that agree on the exact fields, where one
  tolerant field decides; a tolerance as wide as a field's spread decides nothing. Where several
  do, by a join on value bins, which only brings together values that are near each other.

Equal rows and values are folded map-side before anything is shuffled, so a
group of copies costs one row per task, and the joins are inner joins, which
adaptive skew handling can split on both sides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions import compare as C
from tallymark.functions import values as V
from tallymark.operators.folding import count_equal, tasks_for
from tallymark.operators.joins import HotKey, align_key_types, only_hot

# Bin width of an absolute tolerance, in tolerances: wide enough that rounding of
# the quotient can never part two matching values by more than one bin.
BIN_TOLERANCES = 4.0
# Narrowest bin of a percentage tolerance, on the logarithm of the value.
NARROWEST_LOG_BIN = 1e-6
# Fields whose bins guide the join on all fields; each triples the folded target rows.
GUIDES = 2


@dataclass(frozen=True)
class Compared:
    """A compared field with its types on both sides."""

    name: str
    source_type: T.DataType
    target_type: T.DataType
    tolerance: float | int | str | None

    @property
    def parsed(self) -> tuple[str, float] | None:
        return C.parse_tolerance(self.tolerance)

    @property
    def binnable(self) -> bool:
        return self.parsed is not None and (self.parsed[0] == "absolute" or self.parsed[1] < 1)


def _canonical(col: Column, own: T.DataType, other: T.DataType, side: str) -> Column:
    """Text that is equal on both sides exactly when an exact comparison matches."""
    col = V.clean(col, own)
    if V.family(own) != V.family(other):
        return F.when(col.isNotNull(), F.lit(side))  # never equal
    if own != other:
        if V.family(own) == V.DATETIME:
            own, col = T.TimestampNTZType(), col.cast("timestamp_ntz")
        elif V.family(own) == V.NUMBER:
            whole = all(V.is_integral(d) or isinstance(d, T.BooleanType) for d in (own, other))
            own = T.LongType() if whole else T.DoubleType()
            col = col.cast(own)
    # adding zero leaves one zero only; the plain rendering tells any two doubles apart
    return (col.cast("double") + F.lit(0.0)).cast("string") if V.is_floating(own) else V.as_text(col, own)


def _bins(field: Compared, number: Column) -> tuple[Column, Column]:
    """Sign and bin of a number; matching values are at most one bin apart and of one sign."""
    kind, amount = field.parsed
    if kind == "absolute":
        return F.lit(0.0), F.rint(number / F.lit((amount + C.ABSOLUTE_SLACK) * BIN_TOLERANCES))
    width = max(-math.log1p(-amount) * 1.01, NARROWEST_LOG_BIN)
    sign = F.signum(number)
    return sign, F.when(sign == 0, F.lit(0.0)).otherwise(F.rint(F.ln(F.abs(number)) / F.lit(width)))


def _near(bin_: Column) -> Column:
    """The bin and its neighbours, each once; no bin stays no bin."""
    around = F.array_distinct(F.array(bin_ - 1, bin_, bin_ + 1))
    return F.when(bin_.isNull(), F.array(F.lit(None).cast("double"))).otherwise(around)


def in_order(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of finite doubles, neighbours one apart; applied to these as doubles' bits, the way back."""
    bits = x.view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def bounds(values: np.ndarray, kind: str, amount: float) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest number that matches each value, to the last bit, by bisection over the doubles."""
    finite = np.isfinite(values)
    own = np.where(finite, values, 0.0)

    def close(place: np.ndarray) -> np.ndarray:
        t = in_order(place).view(np.float64)
        with np.errstate(all="ignore"):
            if kind == "absolute":
                return (np.abs(own - t) <= amount + C.ABSOLUTE_SLACK) | (own == t)
            return np.where(own == 0, t == 0, np.abs(own - t) / np.abs(own) <= amount)

    ends = []
    for limit in (-np.finfo(np.float64).max, np.finfo(np.float64).max):
        inside, outside = in_order(own), in_order(np.full(len(own), limit))
        inside = np.where(close(outside), outside, inside)
        for _ in range(64):
            middle = (inside >> 1) + (outside >> 1) + (inside & outside & 1)
            good = close(middle)
            inside, outside = np.where(good, middle, inside), np.where(good, outside, middle)
        ends.append(np.where(finite, in_order(inside).view(np.float64), values))  # an infinite number matches itself alone
    return ends[0], ends[1]


def rank_pairs(source: DataFrame, target: DataFrame, keys: Sequence[str], field: Compared, rows: int = 0) -> DataFrame:
    """One row: pairs of rows with equal ``keys`` whose values match, counted by ranks.

    Both sides together have at most ``rows`` rows.

    Both sides have the keys, ``value`` (a number that is no null) and ``rows``. What a source
    value's bounds are worth is the target rows before them in one common order; that order is dealt by
    range over tasks, which count their own part, and a row per task brings the parts together.
    """
    kind, amount = field.parsed
    marked = [c for k in keys for c in (F.col(k), F.col(k).isNull())]  # a hash passes over nulls
    group = F.xxhash64(*marked).alias("g0"), F.xxhash64(F.lit(1), *marked).alias("g1")  # rows of equal keys, side by side
    bare = [side.select(*group, "value", "rows") for side in (source, target)]

    def queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if kind == "percentage":  # an infinite source value is within no share of itself
                batch = batch.filter(pa.array(np.isfinite(batch.column("value").to_numpy()), pa.bool_()))
            low, high = bounds(batch.column("value").to_numpy(), kind, amount)
            rows = batch.column("rows").to_numpy()
            for at, place, weight in ((low, 0, -rows), (high, 2, rows)):
                n = len(rows)
                yield pa.record_batch(
                    [batch.column("g0"), batch.column("g1"), pa.array(at), pa.array(np.full(n, place, np.int32)),
                     pa.array(weight), pa.array(np.zeros(n, np.int64))],
                    names=names,
                )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = weights = pairs = 0
        for batch in batches:
            rows, weight = batch.column("rows").to_numpy(), batch.column("weight").to_numpy()
            before = np.cumsum(rows)  # within a batch; what is before it counts for all
            pairs += sum(int(w) * int(n) for w, n in zip(weight[weight != 0], before[weight != 0])) + seen * int(weight.sum())
            weights += int(weight.sum())
            seen += int(rows.sum())
        yield pa.record_batch(
            [pa.array([TaskContext.get().partitionId()], pa.int64()), *(pa.array([str(x)]) for x in (seen, weights, pairs))],
            names=["task", "seen", "weights", "pairs"],
        )

    names = ["g0", "g1", "at", "place", "weight", "rows"]
    asked = bare[0].mapInArrow(queries, "g0 long, g1 long, at double, place int, weight long, rows long")
    zero = F.lit(0).cast("long")
    held = bare[1].select("g0", "g1", F.col("value").alias("at"), F.lit(1).alias("place"), zero.alias("weight"), "rows")
    order = ("g0", "g1", "at", "place")
    tasks = tasks_for(2 * rows)
    both = asked.union(held)
    ordered = (both.repartitionByRange(tasks, *order) if tasks > 1 else both.repartitionByRange(*order)).sortWithinPartitions(*order)
    parts = ordered.mapInArrow(count, "task long, seen string, weights string, pairs string")
    parts = parts.select("task", *(F.col(c).cast("decimal(38,0)").alias(c) for c in ("seen", "weights", "pairs")))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    carried = F.coalesce(F.sum("seen").over(before), F.lit(0)).cast("decimal(19,0)")
    return parts.select("pairs", (carried * F.col("weights").cast("decimal(18,0)")).alias("more")).agg(
        F.coalesce(F.sum(F.col("pairs") + F.col("more")), F.lit(0)).cast("bigint").alias("matches")
    )


def _sum(expression: Column) -> Column:
    return F.coalesce(F.sum(expression), F.lit(0)).cast("bigint")


class HotStatistics:
    """Counts over the pairs of the hot keys found on both sides."""

    def __init__(
        self,
        source: DataFrame,
        target: DataFrame,
        names: Sequence[str],
        fields: Sequence[Compared],
        hot: Sequence[HotKey],
        null_keys: str,
    ):
        self.hot = list(hot)
        self.null_keys = null_keys
        self.fields = list(fields)
        self.meeting = [key for key in hot if key.meets(null_keys)]
        source, target = align_key_types(source, target, names)
        self.spark = source.sparkSession
        self.rows = {"source": sum(k.source_rows for k in self.meeting), "target": sum(k.target_rows for k in self.meeting)}
        self.sides = {
            "source": self._states(only_hot(source, names, self.meeting), "source"),
            "target": self._states(only_hot(target, names, self.meeting), "target"),
        }

    def _states(self, rows: DataFrame, side: str) -> DataFrame:
        """Per field what comparing it takes: null flag, and canonical text or number."""
        columns = [F.col("__tag")]
        for i, field in enumerate(self.fields):
            own, other = field.source_type, field.target_type
            if side == "target":
                own, other = other, own
            col = F.col(f"`{side}_{field.name}`")
            columns.append(V.null_test(col, own).alias(f"null{i}"))
            if field.parsed is None:
                columns.append(_canonical(col, own, other, side).alias(f"value{i}"))
            else:
                columns.append((V.as_number(col, own) + F.lit(0.0)).alias(f"value{i}"))
        return rows.select(*columns)

    @property
    def pairs(self) -> int:
        return sum(key.source_rows * key.target_rows for key in self.meeting)

    @property
    def alone(self) -> tuple[int, int]:
        """Rows of hot keys without a partner: source, target."""
        apart = [key for key in self.hot if not key.meets(self.null_keys)]
        return sum(key.source_rows for key in apart), sum(key.target_rows for key in apart)

    # -- fully matching pairs ------------------------------------------------

    def _guides(self) -> list[int]:
        """The tolerant fields whose bins the join on all fields goes by: those that tell values apart best."""
        binnable = [i for i, f in enumerate(self.fields) if f.binnable]
        if len(binnable) <= GUIDES:
            return binnable
        bins = [F.approx_count_distinct(_bins(self.fields[i], F.col(f"value{i}"))[1]).alias(str(i)) for i in binnable]
        spread = self.sides["source"].agg(*bins).first()  # one row
        return sorted(binnable, key=lambda i: -spread[str(i)])[:GUIDES]

    def matched(self) -> DataFrame:
        """One row: pairs on which all fields match."""
        values = [f"value{i}" for i in range(len(self.fields))]
        s, t = [
            count_equal(self.sides[side].select("__tag", *values), self.rows[side]) for side in ("source", "target")
        ]
        exact = [i for i, f in enumerate(self.fields) if f.parsed is None]
        tolerant = [i for i, f in enumerate(self.fields) if f.parsed is not None]
        deciding = [i for i in tolerant if i not in self._covering]
        if len(deciding) <= 1:
            return self._matched_by_rank(s, t, exact, tolerant, deciding)
        on = [F.col("s.__tag") == F.col("t.__tag")]
        on += [F.col(f"s.value{i}").eqNullSafe(F.col(f"t.value{i}")) for i in exact]
        for i in self._guides():
            sign, bin_ = _bins(self.fields[i], F.col(f"value{i}"))
            s = s.withColumns({f"sign{i}": sign, f"bin{i}": bin_})
            t = t.withColumn(f"sign{i}", sign).withColumn(f"bin{i}", F.explode(_near(bin_)))
            on += [F.col(f"s.{c}{i}").eqNullSafe(F.col(f"t.{c}{i}")) for c in ("sign", "bin")]
        joined = s.alias("s").join(t.alias("t"), reduce(lambda a, b: a & b, on), "inner")
        for i in tolerant:
            joined = joined.filter(
                C.tolerant_match(F.col(f"s.value{i}"), F.col(f"t.value{i}"), *self.fields[i].parsed)
            )
        return joined.agg(_sum(F.col("s.rows") * F.col("t.rows")).alias("matched"))

    @cached_property
    def _covering(self) -> set[int]:
        """Tolerant fields on which any two numbers match, as the tolerance is as wide as their spread."""
        tolerant = [i for i, f in enumerate(self.fields) if f.parsed is not None]
        if len(tolerant) < 2:
            return set()
        ends = []
        for side in ("source", "target"):
            numbers = [F.col(f"value{i}") for i in tolerant]
            wanted = [f(c) for c in numbers for f in (F.min, F.max, lambda c: F.min(F.abs(c)))]
            ends.append(list(self.sides[side].agg(*wanted).first()))  # one row
        found = set()
        for k, i in enumerate(tolerant):
            (s_low, s_high, s_least), (t_low, t_high, _) = (e[3 * k : 3 * k + 3] for e in ends)
            if s_low is None or t_low is None:
                continue
            apart = max(abs(s_high - t_low), abs(t_high - s_low))
            kind, amount = self.fields[i].parsed
            allowed = amount if kind == "absolute" else amount * s_least * (1 - 1e-9)
            if math.isfinite(apart) and (apart <= allowed if kind == "absolute" else s_least > 0 and apart <= allowed):
                found.add(i)
        return found

    def _matched_by_rank(
        self, s: DataFrame, t: DataFrame, exact: Sequence[int], tolerant: Sequence[int], deciding: Sequence[int]
    ) -> DataFrame:
        """Pairs of folded rows that agree on tag, exact values and which numbers are missing, and match on one field."""
        equal = [F.col("__tag"), *[F.col(f"value{i}") for i in exact], *[F.col(f"value{i}").isNull() for i in tolerant]]
        marks = [c.alias(f"k{i}") for i, c in enumerate(equal)]
        keys = [f"k{i}" for i in range(len(equal))]
        value = F.col(f"value{deciding[0]}") if deciding else F.lit(None).cast("double")
        s, t = [
            count_equal(side.select(*marks, value.alias("value"), "rows"), rows, weight="rows")
            for side, rows in ((s, self.rows["source"]), (t, self.rows["target"]))
        ]
        # without a number to compare, agreeing is matching
        same = reduce(lambda a, b: a & b, [F.col(f"s.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys])
        bare = [side.filter("value is null") for side in (s, t)]
        agreed = bare[0].alias("s").join(bare[1].alias("t"), same, "inner").agg(_sum(F.col("s.rows") * F.col("t.rows")).alias("matched"))
        if not deciding:
            return agreed
        parts = [side.filter("value is not null") for side in (s, t)]
        near = rank_pairs(*parts, keys, self.fields[deciding[0]], sum(self.rows.values())).select(F.col("matches").alias("matched"))
        return agreed.union(near).agg(_sum(F.col("matched")).alias("matched"))

    def counts(self) -> DataFrame:
        """One row: pairs matched and different, rows missing on either side."""
        alone_source, alone_target = self.alone
        matched = self.matched() if self.meeting else self.spark.range(1).select(F.lit(0).cast("bigint").alias("matched"))
        return matched.select(
            "matched",
            (F.lit(self.pairs).cast("bigint") - F.col("matched")).alias("different"),
            F.lit(alone_source).cast("bigint").alias("missing_in_target"),
            F.lit(alone_target).cast("bigint").alias("missing_in_source"),
        )

    # -- per field ---------------------------------------------------------------

    def _tallies(self, side: str) -> DataFrame:
        """Per hot key and field: rows, and rows that are null, no number, or neither."""
        tests = []
        for i, field in enumerate(self.fields):
            unread = F.col(f"value{i}").isNull() if field.parsed else F.col(f"null{i}")
            tests += [F.count_if(F.col(f"null{i}")).alias(f"n{i}"), F.count_if(unread).alias(f"u{i}")]
        wide = self.sides[side].groupBy("__tag").agg(F.count(F.lit(1)).alias("rows"), *tests)
        rows = [
            F.struct(F.lit(i).alias("field"), F.col(f"n{i}").alias("nulls"), F.col(f"u{i}").alias("unread"))
            for i in range(len(self.fields))
        ]
        return wide.select("__tag", "rows", F.inline(F.array(*rows)))

    def _value_counts(self, side: str, indexes: Sequence[int]) -> DataFrame:
        """Per hot key, field and value: rows."""
        rows = [F.struct(F.lit(i).alias("field"), F.col(f"value{i}").alias("value")) for i in indexes]
        long = self.sides[side].select("__tag", F.inline(F.array(*rows))).filter("value is not null")
        return count_equal(long, self.rows[side] * len(indexes))

    def _exact_matches(self, indexes: Sequence[int]) -> DataFrame:
        s, t = self._value_counts("source", indexes), self._value_counts("target", indexes)
        met = s.withColumnRenamed("rows", "s_rows").join(t, ["__tag", "field", "value"], "inner")
        return met.groupBy("field").agg(F.sum(F.col("s_rows") * F.col("rows")).alias("matches"))

    def _near_matches(self, index: int) -> DataFrame:
        s, t = self._value_counts("source", [index]), self._value_counts("target", [index])
        found = rank_pairs(s, t, ["__tag"], self.fields[index], sum(self.rows.values()))
        return found.select(F.lit(index).alias("field"), F.col("matches").cast("bigint").alias("matches"))

    def field_counts(self) -> DataFrame:
        """Per field: matches, comparable pairs, and pairs with a value that should be a number and is none."""
        s, t = self._tallies("source"), self._tallies("target")
        joined = s.alias("s").join(t.alias("t"), ["__tag", "field"], "inner")
        pairs = F.col("s.rows") * F.col("t.rows")
        both_null = F.col("s.nulls") * F.col("t.nulls")
        s_read = F.col("s.rows") - F.col("s.unread") + F.col("s.nulls")
        t_read = F.col("t.rows") - F.col("t.unread") + F.col("t.nulls")
        parts = [
            joined.groupBy("field").agg(
                # neither side is a number, but not for lack of values: that counts as a match
                F.sum(F.col("s.unread") * F.col("t.unread") - both_null).alias("matches"),
                F.sum(pairs - both_null).alias("comparable"),
                F.sum(pairs - s_read * t_read).alias("non_numeric"),
            )
        ]
        exact = [i for i, f in enumerate(self.fields) if f.parsed is None]
        if exact:
            parts.append(self._exact_matches(exact))
        parts += [self._near_matches(i) for i, f in enumerate(self.fields) if f.parsed is not None]
        stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        summed = stacked.groupBy("field").agg(
            *[_sum(F.col(c)).alias(c) for c in ("matches", "comparable", "non_numeric")]
        )
        labels = F.array(*[F.lit(f.name) for f in self.fields])
        return summed.withColumn("field", F.get(labels, F.col("field")))
