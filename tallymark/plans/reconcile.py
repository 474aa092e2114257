"""Reconcile two tables under a spec.

Everything is one lazy plan: filter, re-key, normalize and map each side, one
full outer join, post-join calculations, comparison, classification. Nothing
runs before the caller acts on a result, except the light hot-key check, which
is left out for small inputs.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions import compare as C
from tallymark.functions import values as V
from tallymark.operators import joins
from tallymark.operators.filters import apply_filters
from tallymark.operators.folding import estimated_bytes
from tallymark.operators.hotstats import Compared, HotStatistics
from tallymark.operators.keys import (
    calculate_keys,
    check_key_families,
    duplicate_keys,
    expand_alternative_keys,
)
from tallymark.operators.mapping import ColumnUpdates
from tallymark.operators.postjoin import Adjustment, adjustments, apply_post_join
from tallymark.plans.spec import SOURCE, TARGET, Field, Spec, describe_expression, frame_expression, parse_spec

log = logging.getLogger(__name__)

MATCHED, DIFFERENT = "matched", "different"
MISSING_IN_TARGET, MISSING_IN_SOURCE = "missing_in_target", "missing_in_source"
CATEGORIES = (MATCHED, DIFFERENT, MISSING_IN_TARGET, MISSING_IN_SOURCE)

SUMMARY_COLUMNS = (
    "total_source", "total_target", MATCHED, DIFFERENT, MISSING_IN_SOURCE, MISSING_IN_TARGET, "match_rate",
    "difference_rate",
)
FIELD_COUNTS = ("matches", "comparable", "non_numeric")

# Inputs whose keys are estimated smaller than this are not worth the hot-key check.
SKEW_CHECK_BYTES = 1 << 20
# Beyond this many compared fields the statistics go through long form, to keep generated code small.
WIDE_FIELDS = 150


@dataclass(frozen=True)
class Skew:
    """When to look for hot keys, what counts as one, and how many of its rows a task may get."""

    mode: str = "auto"
    share: float = joins.HOT_SHARE
    min_rows: int = joins.HOT_ROWS
    rows_per_cell: int = 500_000

    def __post_init__(self) -> None:
        if self.mode not in ("auto", "always", "ignore"):
            raise ValueError(f"skew must be auto, always or ignore, got {self.mode!r}")


@dataclass(frozen=True)
class Step:
    """One audited value change of a side: columns before and after, kind and rule."""

    field: str
    kind: str
    before: str
    after: str
    rule: str


@dataclass
class Side:
    """One side ready for the join: keys and fields under canonical names."""

    name: str
    rows: DataFrame  # after filters and key work, raw columns
    prepared: DataFrame
    raw_columns: dict[str, str]  # field or key -> column holding its value before mapping
    present_fields: set[str]
    steps: list[Step]
    ordinals: dict[str, int]


def _clean_names(df: DataFrame) -> DataFrame:
    stripped = [c.strip() for c in df.columns]
    return df if stripped == df.columns else df.toDF(*stripped)


def _other_type(field: Field, other: DataFrame, other_side: str) -> str:
    column = field.column(other_side)
    if field.calculation(other_side) is not None:
        return other.select(frame_expression(other, field.calculation(other_side))).schema[0].dataType.simpleString()
    return other.schema[column].dataType.simpleString() if column in other.columns else "string"


def _normalize(raw: DataFrame, other: DataFrame, spec: Spec, side: str) -> tuple[DataFrame, set[str]]:
    """Keys and configured fields under canonical names, in one projection."""
    other_side = TARGET if side == SOURCE else SOURCE
    columns: dict[str, Column] = {}
    present: set[str] = set()
    for key in spec.keys:
        if key.column(side) in raw.columns:
            columns[key.name] = F.col(f"`{key.column(side)}`")
    for field in spec.fields:
        calculation, actual = field.calculation(side), field.column(side)
        if calculation is not None:
            columns[field.name] = frame_expression(raw, calculation)
            present.add(field.name)
        elif actual in raw.columns:
            columns[field.name] = F.col(f"`{actual}`")
            present.add(field.name)
        elif field.name not in columns:
            log.warning("field %r not found in %s data; it is taken as empty", field.name, side)
            columns[field.name] = F.lit(None).cast(_other_type(field, other, other_side))
    for field in spec.fields:
        # a condition column that is no configured field comes straight from the raw table
        wanted = field.conditional_mapping and field.conditional_mapping.condition_field
        if wanted and wanted not in columns and wanted in raw.columns:
            columns[f"__condition_{wanted}"] = F.col(f"`{wanted}`")
    selected = raw.select(*[c.alias(n) for n, c in columns.items()])
    nan_free = [V.clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in selected.schema.fields]
    return selected.select(*nan_free), present


def _map_and_transform(df: DataFrame, spec: Spec, side: str) -> tuple[DataFrame, dict[str, str], list[Step]]:
    """Mapping, then transformation, then the declared type: field by field in spec order.

    A condition field that comes earlier is therefore seen as already mapped.
    """
    raw_columns: dict[str, str] = {}
    steps: list[Step] = []
    columns = ColumnUpdates(df)
    for field in spec.fields:
        name = field.name
        if not (field.has_steps(side) or field.adjusted_after_join()):
            continue
        raw_columns[name] = before = f"__raw_{name}"
        columns.set(before, columns.column(name), columns.dtype(name))
        taken: list[tuple[str, str]] = []  # kind and rule of the steps on this field

        if field.mapping is not None and field.applies(side):
            columns.map(name, field.mapping)
            taken.append(("mapping", ""))
        elif field.conditional_applies(side):
            condition = field.conditional_mapping
            configured = columns.has(condition.condition_field)
            column = condition.condition_field if configured else f"__condition_{condition.condition_field}"
            columns.map_where(name, condition, column)
            taken.append(("conditional", condition.describe()))
        transforms = field.transformation is not None and field.applies(side)
        if taken and (transforms or field.type is not None):
            columns.set(f"__mapped_{name}", columns.column(name), columns.dtype(name))
        if transforms:
            columns.transform(name, field.transformation)
            taken.append(("transformation", describe_expression(field.transformation)))
            if field.type is not None:
                columns.set(f"__transformed_{name}", columns.column(name))
        if field.type is not None:
            columns.cast(name, field.type)

        for kind, rule in taken:
            kept = f"__transformed_{name}" if kind == "transformation" else f"__mapped_{name}"
            after = kept if columns.has(kept) else name
            steps.append(Step(name, kind, before, after, rule))
            before = after
    return columns.settle(), raw_columns, steps


def _prepare(raw: DataFrame, other: DataFrame, spec: Spec, side: str, ordinals: dict[str, int]) -> Side:
    normalized, present = _normalize(raw, other, spec, side)
    prepared, raw_columns, steps = _map_and_transform(normalized, spec, side)
    return Side(side, raw, prepared, raw_columns, present, steps, ordinals)


class Reconciliation:
    """Lazy results of one reconciliation; every method returns a DataFrame."""

    def __init__(
        self,
        spec: Spec,
        source: Side,
        target: Side,
        null_keys: str,
        skew: Skew,
        stored: tuple[DataFrame, list[Adjustment]] | None = None,
    ):
        self.spec = spec
        self.source = source
        self.target = target
        self._null_keys = null_keys
        self._skew = skew
        self._stored = stored

    # -- the joined row ----------------------------------------------------

    @cached_property
    def hot_keys(self) -> list[joins.HotKey]:
        if self._skew.mode == "ignore":
            return []
        s, t = self.source.prepared, self.target.prepared
        names = self.spec.key_names
        keys_only = [side.select(*[F.col(f"`{n}`") for n in names]) for side in (s, t)]
        if self._skew.mode == "auto" and max(estimated_bytes(k) for k in keys_only) < SKEW_CHECK_BYTES:
            return []
        return joins.find_hot_keys(*keys_only, names, share=self._skew.share, min_rows=self._skew.min_rows)

    def _side_columns(self, fields: Sequence[Field], raw: bool = False) -> list[DataFrame]:
        """Both sides as they go into the join: keys, ``source_*`` / ``target_*``, raw values on demand."""
        sides = []
        for side in (self.source, self.target):
            columns = [F.col(f"`{n}`") for n in self.spec.key_names]
            for field in fields:
                columns.append(F.col(f"`{field.name}`").alias(f"{side.name}_{field.name}"))
            if raw:
                present = set(self.spec.key_names) | {f"{side.name}_{f.name}" for f in fields}
                extra = {alias: column for column, alias in self._audit_columns(side).items() if alias not in present}
                columns += [F.col(f"`{column}`").alias(alias) for alias, column in extra.items()]
            sides.append(side.prepared.select(*columns))
        return sides

    def _audit_columns(self, side: Side) -> dict[str, str]:
        """Where each side column of the audits and raw values is found in the join, each shipped once.

        The value a field ends up with is the compared value itself, unless a post-join step may change that.
        """
        found = {n: n for n in self.spec.key_names}
        found |= {f.name: f"{side.name}_{f.name}" for f in self.spec.paired_fields if not f.adjusted_after_join()}
        wanted = [*side.raw_columns.values(), *[c for step in side.steps for c in (step.before, step.after)]]
        for column in wanted:
            found.setdefault(column, f"__{side.name}{column if column.startswith('__') else '__final_' + column}")
        return found

    def _joined(self, raw: bool, folded: bool = False) -> DataFrame:
        sides = self._side_columns(self.spec.paired_fields, raw)
        return joins.outer_join(
            *sides,
            self.spec.key_names,
            null_keys=self._null_keys,
            hot=self.hot_keys,
            rows_per_cell=self._skew.rows_per_cell,
            folded=folded,
        )

    def _compared(self, joined: DataFrame) -> tuple[DataFrame, list[Adjustment]]:
        s, t = F.col(joins.SOURCE_PRESENT).isNotNull(), F.col(joins.TARGET_PRESENT).isNotNull()
        indicator = F.when(s & t, "both").when(s, "left_only").otherwise("right_only")
        df, steps = apply_post_join(joined.withColumn("merge_indicator", indicator), self.spec)
        both = F.col("merge_indicator") == "both"
        matches = {f.name: self._match(df, f) for f in self.spec.compared_fields}
        df = df.select("*", *[m.alias(f"__match_{n}") for n, m in matches.items()])
        agree = reduce(lambda a, b: a & b, [F.col(f"`__match_{n}`") for n in matches], F.lit(True))
        category = (
            F.when(both & agree, MATCHED)
            .when(both, DIFFERENT)
            .when(F.col("merge_indicator") == "left_only", MISSING_IN_TARGET)
            .otherwise(MISSING_IN_SOURCE)
        )
        return df.withColumn("category", category), steps

    @staticmethod
    def _match(df: DataFrame, field: Field) -> Column:
        s, t = f"source_{field.name}", f"target_{field.name}"
        s_type, t_type = df.schema[s].dataType, df.schema[t].dataType
        if V.family(s_type) != V.family(t_type) and field.tolerance is None:
            log.warning(
                "field %r is %s in source and %s in target; only missing values match",
                field.name, s_type.simpleString(), t_type.simpleString(),
            )
        return C.field_match(F.col(f"`{s}`"), s_type, F.col(f"`{t}`"), t_type, field.tolerance)

    @cached_property
    def _folded(self) -> tuple[DataFrame, list[Adjustment]]:
        """Compared rows with everything the audits need; hot pairs still folded."""
        return self._stored or self._compared(self._joined(raw=True))

    @cached_property
    def _lean(self) -> DataFrame:
        """Compared rows without raw values."""
        if self._stored:
            return self._stored[0]
        return self._compared(self._joined(raw=False))[0]

    @cached_property
    def _weighed(self) -> DataFrame:
        """Compared rows to count, all pairs of equal rows of hot keys as one."""
        if self._stored:
            return self._stored[0]
        return self._compared(self._joined(raw=False, folded=True))[0]

    @cached_property
    def _full(self) -> tuple[DataFrame, list[Adjustment]]:
        df, steps = self._folded
        return joins.unfold(df), steps

    def materialize(self, path: str) -> Reconciliation:
        """Write the compared rows once, a folder per category, and answer from there.

        Worth it before asking for several results: the join then runs once, a
        report reads its own category only, and a lost executor costs a re-read.
        ``path`` must be a folder all executors share.
        """
        df, steps = self._folded
        df.write.mode("overwrite").partitionBy("category").parquet(path)
        stored = df.sparkSession.read.schema(df.schema).parquet(path).select(*[F.col(f"`{c}`") for c in df.columns])
        return Reconciliation(self.spec, self.source, self.target, self._null_keys, self._skew, (stored, steps))

    @cached_property
    def _counted(self) -> tuple[DataFrame, HotStatistics | None]:
        """Compared rows to count, and the hot keys' share, whose pairs are never formed.

        A post-join calculation may read any column of both sides, so with one
        the hot pairs have to be formed, folded as they are in the join.
        """
        if self._stored or not self.hot_keys or any(f.adjusted_after_join() for f in self.spec.paired_fields):
            return self._weighed, None
        names, fields = self.spec.key_names, self.spec.compared_fields
        s, t = joins.align_key_types(*self._side_columns(fields), names)
        cold = [joins.without_hot(side, names, self.hot_keys) for side in (s, t)]
        compared, _ = self._compared(joins.outer_join(*cold, names, null_keys=self._null_keys))
        typed = [
            Compared(f.name, s.schema[f"source_{f.name}"].dataType, t.schema[f"target_{f.name}"].dataType, f.tolerance)
            for f in fields
        ]
        return compared, HotStatistics(s, t, names, typed, self.hot_keys, self._null_keys)

    # -- row results -------------------------------------------------------

    @staticmethod
    def _unfolded(df: DataFrame, *columns: Column) -> DataFrame:
        """Columns of every joined row, computed once for all pairs of equal rows."""
        weight = [joins.WEIGHT] if joins.WEIGHT in df.columns else []
        return joins.unfold(df.select(*columns, *weight))

    def _broken_fields(self) -> Column:
        names = [f.name for f in self.spec.compared_fields]
        broken = [F.when(~F.col(f"`__match_{n}`"), F.lit(n)) for n in names]
        listed = F.array_join(F.array(*broken), ",") if broken else F.lit("")
        return F.when(F.col("category") == DIFFERENT, listed)

    def prepared(self, side: str) -> DataFrame:
        """One side after filters, key work, mapping and transformation, under canonical names."""
        own = {SOURCE: self.source, TARGET: self.target}[side]
        names = dict.fromkeys([*self.spec.key_names, *[f.name for f in self.spec.fields]])
        return own.prepared.select(*[F.col(f"`{n}`") for n in names])

    def merged(self) -> DataFrame:
        """Joined rows: keys, ``source_*``, ``target_*`` and the merge indicator."""
        pairs = [f"{side}_{f.name}" for f in self.spec.paired_fields for side in (SOURCE, TARGET)]
        columns = [F.col(f"`{c}`") for c in (*self.spec.key_names, *pairs)]
        return self._unfolded(self._lean, *columns, F.col("merge_indicator"))

    def classified(self, folded: bool = False) -> DataFrame:
        """Every joined row once, with its category and the fields it broke on.

        With ``folded`` the pairs of equal rows of a hot key are one row, and ``records`` says how many there are.
        """
        pairs = [f"{side}_{f.name}" for f in self.spec.paired_fields for side in (SOURCE, TARGET)]
        columns = [F.col(f"`{c}`") for c in (*self.spec.key_names, *pairs)]
        columns += [F.col("category"), self._broken_fields().alias("diff_fields")]
        if not folded:
            return self._unfolded(self._lean, *columns)
        weight = F.col(joins.WEIGHT) if joins.WEIGHT in self._weighed.columns else F.lit(1).cast("bigint")
        return self._weighed.select(*columns, weight.alias("records"))

    def records(self, category: str) -> DataFrame:
        if category not in CATEGORIES:
            raise ValueError(f"category must be one of {CATEGORIES}, got {category!r}")
        return self.classified().filter(F.col("category") == category)

    def missing_in_target(self) -> DataFrame:
        """Source rows without a partner, by an anti join alone."""
        return self._alone(self.source, self.target)

    def missing_in_source(self) -> DataFrame:
        """Target rows without a partner, by an anti join alone."""
        return self._alone(self.target, self.source)

    def _alone(self, own: Side, other: Side) -> DataFrame:
        names = self.spec.key_names
        lonely = joins.anti_join(own.prepared, other.prepared, names, null_keys=self._null_keys)
        fields = [F.col(f"`{f.name}`").alias(f"{own.name}_{f.name}") for f in self.spec.paired_fields]
        return lonely.select(*[F.col(f"`{n}`") for n in names], *fields)

    def breaks(self) -> DataFrame:
        """One row per broken field of a different record: keys, field, both values as text."""
        df = self._lean
        entries = []
        for field in self.spec.compared_fields:
            s, t = f"source_{field.name}", f"target_{field.name}"
            entry = F.struct(
                F.lit(field.name).alias("field"),
                V.as_text(F.col(f"`{s}`"), df.schema[s].dataType).alias("source_value"),
                V.as_text(F.col(f"`{t}`"), df.schema[t].dataType).alias("target_value"),
            )
            entries.append(F.when(~F.col(f"`__match_{field.name}`"), entry))
        keys = [F.col(f"`{n}`") for n in self.spec.key_names]
        if not entries:
            empty = F.array().cast("array<struct<field:string,source_value:string,target_value:string>>")
            return self._unfolded(df, *keys, F.inline(empty))
        different = df.filter(F.col("category") == DIFFERENT)
        return self._unfolded(different, *keys, F.inline(F.array_compact(F.array(*entries))))

    # -- statistics --------------------------------------------------------

    def _statistics_row(self, with_fields: bool) -> DataFrame:
        """One row: record counts and, numbered, the counts of every compared field."""
        rows, hot = self._counted
        counts = [joins.weighted_count(rows, F.col("category") == c).alias(c) for c in CATEGORIES]
        labels: list[str] = []
        if with_fields:
            both = F.col("merge_indicator") == "both"
            for i, field in enumerate(self.spec.compared_fields):
                for label, test in zip(FIELD_COUNTS, self._field_tests(rows, field)):
                    labels.append(f"{label}_{i}")
                    counts.append(joins.weighted_count(rows, both & test).alias(labels[-1]))
        parts = [rows.agg(*counts)]
        if hot is not None:
            parts.append(hot.counts())
            if labels and hot.meeting:
                per_field = hot.field_counts()
                at = {f.name: i for i, f in enumerate(self.spec.compared_fields)}
                parts.append(
                    per_field.agg(
                        *[
                            F.sum(F.when(F.col("field") == name, F.col(label))).alias(f"{label}_{i}")
                            for name, i in at.items()
                            for label in FIELD_COUNTS
                        ]
                    )
                )
        for side in (self.source, self.target):
            parts.append(side.rows.agg(F.count(F.lit(1)).alias(f"total_{side.name}")))
        # one-row tables, put together by summing
        stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        names = ["total_source", "total_target", MATCHED, DIFFERENT, MISSING_IN_SOURCE, MISSING_IN_TARGET, *labels]
        row = stacked.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
        compared = F.col(MATCHED) + F.col(DIFFERENT)
        return row.withColumns(
            {
                "match_rate": F.coalesce(F.try_divide(F.col(MATCHED), compared), F.lit(0.0)),
                "difference_rate": F.coalesce(F.try_divide(F.col(DIFFERENT), compared), F.lit(0.0)),
            }
        )

    def summary(self) -> DataFrame:
        """One row: record counts and rates. Totals count rows after filters and key expansion."""
        return self._statistics_row(with_fields=False).select(*SUMMARY_COLUMNS)

    def statistics(self) -> DataFrame:
        """The summary row with the field statistics as an array.

        One pass over the joined rows gives both, unless there are more than ``WIDE_FIELDS`` fields.
        """
        if len(self.spec.compared_fields) > WIDE_FIELDS:
            stats = self.field_stats()  # a row per field of the spec
            place = F.array_position(F.array(*[F.lit(f.name) for f in self.spec.compared_fields]), F.col("field"))
            entry = F.struct(place.alias("place"), F.struct(*stats.columns).alias("entry"))
            listed = stats.agg(F.sort_array(F.collect_list(entry)).alias("found"))
            listed = listed.select(F.lit(1).alias("one"), F.col("found.entry").alias("field_statistics"))
            return self.summary().withColumn("one", F.lit(1)).join(listed, "one").drop("one")
        entries = []
        for i, field in enumerate(self.spec.compared_fields):
            matches, comparable, odd = [F.col(f"{label}_{i}") for label in FIELD_COUNTS]
            entries.append(
                F.struct(
                    F.lit(field.name).alias("field"),
                    matches.alias("matches"),
                    (comparable - matches).alias("differences"),
                    comparable.alias("comparable"),
                    F.coalesce(F.try_divide(matches, comparable), F.lit(0.0)).alias("match_rate"),
                    odd.alias("non_numeric"),
                )
            )
        fields = F.array(*entries)
        if not entries:
            fields = F.array().cast(
                "array<struct<field:string,matches:bigint,differences:bigint,comparable:bigint,match_rate:double,"
                "non_numeric:bigint>>"
            )
        return self._statistics_row(with_fields=True).select(*SUMMARY_COLUMNS, fields.alias("field_statistics"))

    def field_stats(self) -> DataFrame:
        """One row per compared field, over rows found on both sides with a value on at least one."""
        if len(self.spec.compared_fields) <= WIDE_FIELDS:
            return self.statistics().select(F.inline("field_statistics"))
        rows, hot = self._counted
        df = rows.filter(F.col("merge_indicator") == "both")
        long = self._wide_stats(df, {f.name: self._field_tests(df, f) for f in self.spec.compared_fields})
        if hot is not None and hot.meeting:
            sums = [F.sum(c).alias(c) for c in FIELD_COUNTS]
            long = long.unionByName(hot.field_counts()).groupBy("field").agg(*sums)
        # fields of which no rows were paired have counts of 0, as in the other form
        every = long.sparkSession.createDataFrame([(f.name,) for f in self.spec.compared_fields], "field string")
        long = every.join(long, "field", "left").fillna(0, list(FIELD_COUNTS))
        rate = F.coalesce(F.try_divide(F.col("matches"), F.col("comparable")), F.lit(0.0))
        return long.select(
            "field",
            "matches",
            (F.col("comparable") - F.col("matches")).alias("differences"),
            "comparable",
            rate.alias("match_rate"),
            "non_numeric",
        )

    @staticmethod
    def _field_tests(df: DataFrame, field: Field) -> tuple[Column, Column, Column]:
        s, t = F.col(f"`source_{field.name}`"), F.col(f"`target_{field.name}`")
        comparable = s.isNotNull() | t.isNotNull()
        match = F.col(f"`__match_{field.name}`")
        odd = F.lit(False)
        if field.tolerance is not None:
            for side, col in ((SOURCE, s), (TARGET, t)):
                number = V.as_number(col, df.schema[f"{side}_{field.name}"].dataType)
                odd = odd | (col.isNotNull() & number.isNull())
        return comparable & match, comparable, odd

    @staticmethod
    def _wide_stats(df: DataFrame, tests: dict[str, tuple[Column, ...]]) -> DataFrame:
        rows = [
            F.struct(
                F.lit(name).alias("field"), match.alias("match"), comparable.alias("comparable"), odd.alias("odd")
            )
            for name, (match, comparable, odd) in tests.items()
        ]
        weight = [joins.WEIGHT] if joins.WEIGHT in df.columns else []
        long = df.select(*weight, F.inline(F.array(*rows)))
        return long.groupBy("field").agg(
            joins.weighted_count(long, F.col("match")).alias("matches"),
            joins.weighted_count(long, F.col("comparable")).alias("comparable"),
            joins.weighted_count(long, F.col("odd")).alias("non_numeric"),
        )

    def field_status(self) -> DataFrame:
        """Field statistics with ``perfect`` or ``imperfect``."""
        status = F.when(F.col("match_rate") >= 1, "perfect").otherwise("imperfect")
        return self.field_stats().withColumn("status", status)

    def duplicate_keys(self) -> DataFrame:
        """Keys that several rows of a side hold; their rows multiply in the join."""
        found = [
            duplicate_keys(side.prepared, self.spec.key_names).withColumn("side", F.lit(side.name))
            for side in (self.source, self.target)
        ]
        return found[0].unionByName(found[1])

    # -- audits ------------------------------------------------------------

    @staticmethod
    def _change_entries(df: DataFrame, side: Side, at: Mapping[str, str]) -> list[Column]:
        entries = []
        for step in side.steps:
            before, after = at[step.before], at[step.after]
            old = V.as_text(F.col(f"`{before}`"), df.schema[before].dataType)
            new = V.as_text(F.col(f"`{after}`"), df.schema[after].dataType)
            rule = F.concat(old, F.lit(" -> "), new) if step.kind == "mapping" else F.lit(step.rule)
            entry = F.struct(
                F.lit(side.name).alias("side"),
                F.lit(step.field).alias("field"),
                F.lit(step.kind).alias("kind"),
                old.alias("original"),
                new.alias("new"),
                rule.alias("rule"),
            )
            entries.append(F.when(old.isNotNull() & new.isNotNull() & (old != new), entry))
        return entries

    @staticmethod
    def _inline_changes(df: DataFrame, keep: list[Column], entries: list[Column]) -> DataFrame:
        if not entries:
            names = ("side", "field", "kind", "original", "new", "rule")
            none = F.array().cast("array<struct<" + ",".join(f"{n}:string" for n in names) + ">>")
            return df.select(*keep, F.inline(none))
        return df.select(*keep, F.inline(F.array_compact(F.array(*entries))))

    def changes(self) -> DataFrame:
        """Values rewritten by mapping or transformation, one row per change."""
        found = []
        for side in (self.source, self.target):
            df = side.prepared
            entries = self._change_entries(df, side, {c: c for c in df.columns})
            found.append(self._inline_changes(df, [F.col(f"`{n}`") for n in self.spec.key_names], entries))
        return found[0].unionByName(found[1])

    def change_counts(self) -> DataFrame:
        """Per rewritten field: values changed, and distinct values before and after.

        Values are counted per distinct value first, which combines map-side, so
        a value shared by many rows costs one row per task.
        """
        found = []
        for side in (self.source, self.target):
            df, rows = side.prepared, []
            for step in side.steps:
                old = V.as_text(F.col(f"`{step.before}`"), df.schema[step.before].dataType)
                new = V.as_text(F.col(f"`{step.after}`"), df.schema[step.after].dataType)
                differs = F.coalesce(old != new, F.lit(False))
                for stage, value, change in (("before", old, differs), ("after", new, F.lit(False))):
                    rows.append(
                        F.struct(
                            F.lit(side.name).alias("side"), F.lit(step.field).alias("field"),
                            F.lit(step.kind).alias("kind"), F.lit(stage).alias("stage"),
                            value.alias("value"), change.alias("change"),
                        )
                    )
            if rows:
                found.append(df.select(F.inline(F.array(*rows))))
        if not found:
            return self.source.prepared.sparkSession.createDataFrame(
                [], "side string, field string, kind string, changed bigint, distinct_before bigint, "
                "distinct_after bigint"
            )
        long = reduce(lambda a, b: a.unionByName(b), found)
        per_value = long.groupBy("side", "field", "kind", "stage", "value").agg(F.count_if("change").alias("changed"))
        present = F.col("value").isNotNull()
        return per_value.groupBy("side", "field", "kind").agg(
            F.sum("changed").alias("changed"),
            F.count_if((F.col("stage") == "before") & present).alias("distinct_before"),
            F.count_if((F.col("stage") == "after") & present).alias("distinct_after"),
        )

    def joined_changes(self) -> DataFrame:
        """The change audit of matched and different records, with their category."""
        df, _ = self._full
        entries = []
        for side in (self.source, self.target):
            entries += self._change_entries(df, side, self._audit_columns(side))
        keep = [F.col(f"`{n}`") for n in self.spec.key_names] + [F.col("category")]
        paired = df.filter(F.col("category").isin(MATCHED, DIFFERENT))
        return self._inline_changes(paired, keep, entries)

    def adjustments(self) -> DataFrame:
        """Values that post-join calculations changed, with the reason."""
        df, steps = self._full
        return adjustments(df, steps, [*self.spec.key_names, "category"])

    def raw_rows(self, category: str, side: Side) -> tuple[DataFrame, dict[str, str]]:
        """Rows of a category, and where a side's values before mapping are: field or key to column.

        Rows that one side lacks need no full outer join, unless a post-join step may change them.
        """
        other = {MISSING_IN_TARGET: self.target, MISSING_IN_SOURCE: self.source}.get(category)
        if other and other is not side and not self._stored and not any(f.adjusted_after_join() for f in self.spec.paired_fields):
            lonely = joins.anti_join(side.prepared, other.prepared, self.spec.key_names, null_keys=self._null_keys)
            names = [*self.spec.key_names, *[f.name for f in self.spec.paired_fields]]
            return lonely, {n: n for n in names} | dict(side.raw_columns)
        found = self._audit_columns(side)
        at = {n: n for n in self.spec.key_names}
        at |= {f.name: f"{side.name}_{f.name}" for f in self.spec.paired_fields}
        at |= {name: found[column] for name, column in side.raw_columns.items()}
        return self._full[0].filter(F.col("category") == category), at


def reconcile(
    source: DataFrame,
    target: DataFrame,
    spec: Mapping[str, Any] | Spec,
    *,
    null_keys: str = "match",
    skew: str | Skew = "auto",
    on_duplicate: str = "multiply",
    drop_null_alternatives: bool = False,
) -> Reconciliation:
    """Set up a reconciliation.

    ``skew``: ``"auto"`` looks for hot keys unless the inputs are small,
    ``"always"`` does regardless, ``"ignore"`` never does; a ``Skew`` sets the
    thresholds too. ``on_duplicate="error"`` counts duplicate keys first and
    refuses them.
    """
    skew = skew if isinstance(skew, Skew) else Skew(skew)
    if on_duplicate not in ("multiply", "error"):
        raise ValueError(f"on_duplicate must be multiply or error, got {on_duplicate!r}")
    parsed = parse_spec(spec)
    raw: dict[str, DataFrame] = {}
    ordinals: dict[str, dict[str, int]] = {}
    for side, df in ((SOURCE, source), (TARGET, target)):
        df = _clean_names(df)
        ordinals[side] = {c: i for i, c in enumerate(df.columns)}
        df = apply_filters(df, parsed.filters.get(side, ()))
        raw[side] = calculate_keys(df, parsed.keys, side)
    raw[TARGET] = expand_alternative_keys(
        raw[TARGET], parsed.keys, drop_null_alternatives=drop_null_alternatives
    )
    sides = [
        _prepare(raw[SOURCE], raw[TARGET], parsed, SOURCE, ordinals[SOURCE]),
        _prepare(raw[TARGET], raw[SOURCE], parsed, TARGET, ordinals[TARGET]),
    ]
    check_key_families(sides[0].prepared, sides[1].prepared, parsed.key_names)
    result = Reconciliation(parsed, *sides, null_keys, skew)
    if on_duplicate == "error" and not result.duplicate_keys().isEmpty():
        raise ValueError("duplicate keys found; see duplicate_keys()")
    return result
