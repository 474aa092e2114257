"""Calculations that see both sides of the joined row, and their audit."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions import values as V
from tallymark.plans.spec import Field, ForceZero, Spec, frame_expression

log = logging.getLogger(__name__)

# Reasons given in the adjustment audit.
FORCED_ZERO_REASON = "Settlement date = reporting date and target MTM is 0"
DEFAULT_REASONS = {
    "source": "Post-merge source calculation applied",
    "target": "Post-merge target calculation applied",
}


@dataclass(frozen=True)
class Adjustment:
    """One adjustment step: where the value before and after it is kept."""

    field: str
    side: str
    before: str
    after: str
    reason: str


def force_zero(df: DataFrame, field: str, names: ForceZero) -> DataFrame | None:
    """Source value 0 where the trade settles on the reporting date and the target value is 0."""
    settle_col, report_col = f"target_{names.settlement_field}", f"target_{names.reporting_field}"
    if settle_col not in df.columns or report_col not in df.columns:
        log.warning("force_zero_when_settled of %r: %s or %s not found", field, settle_col, report_col)
        return None
    source, target = f"source_{field}", f"target_{field}"
    settle_type = df.schema[settle_col].dataType
    settle = F.col(f"`{settle_col}`")
    if V.family(settle_type) == V.DATETIME:
        settle = F.date_format(settle, "yyyy-MM-dd")
    reported = V.day_month_year(F.col(f"`{report_col}`"), df.schema[report_col].dataType)
    settled = settle == F.date_format(reported, "yyyy-MM-dd")
    empty = V.as_number(F.col(f"`{target}`"), df.schema[target].dataType) == 0
    zero = F.lit(0).cast(df.schema[source].dataType)
    return df.withColumn(source, F.when(settled & empty, zero).otherwise(F.col(f"`{source}`")))


def apply_post_join(df: DataFrame, spec: Spec) -> tuple[DataFrame, list[Adjustment]]:
    """Run the post-join steps of all fields in spec order, keeping every value before and after."""
    steps: list[Adjustment] = []

    def record(frame: DataFrame, field: Field, side: str, reason: str, step: Callable[[DataFrame], DataFrame]):
        column, before, after = f"{side}_{field.name}", f"__before_{len(steps)}", f"__after_{len(steps)}"
        steps.append(Adjustment(field.name, side, before, after, reason))
        kept = frame.withColumn(before, F.col(f"`{column}`"))
        return step(kept).withColumn(after, F.col(f"`{column}`"))

    for field in spec.paired_fields:
        names = field.force_zero_when_settled
        if names is not None and force_zero(df, field.name, names) is not None:
            df = record(df, field, "source", FORCED_ZERO_REASON, lambda d, f=field, n=names: force_zero(d, f.name, n))
        for side, expression in (
            ("source", field.post_merge_source_calculation),
            ("target", field.post_merge_target_calculation),
        ):
            if expression is None:
                continue
            reason = field.post_merge_comment or DEFAULT_REASONS[side]
            column = f"{side}_{field.name}"
            df = record(
                df, field, side, reason, lambda d, c=column, e=expression: d.withColumn(c, frame_expression(d, e))
            )
    return df, steps


def _comma_free_number(col: Column, dtype: T.DataType) -> Column:
    if V.family(dtype) == V.TEXT:
        return V.as_number(F.regexp_replace(col, ",", ""), dtype)
    return V.as_number(col, dtype)


def changed(before: Column, before_type: T.DataType, after: Column, after_type: T.DataType) -> Column:
    """Whether a step changed a value: as numbers when both sides are, otherwise as they stand."""
    first, second = _comma_free_number(before, before_type), _comma_free_number(after, after_type)
    numeric = (before.isNull() | first.isNotNull()) & (after.isNull() | second.isNotNull())
    texts = V.as_text(before, before_type).eqNullSafe(V.as_text(after, after_type))
    return F.when(numeric, ~first.eqNullSafe(second)).otherwise(~texts)


def adjustments(df: DataFrame, steps: list[Adjustment], keep: list[str]) -> DataFrame:
    """Long table of changed values: kept columns, side, field, original, adjusted, reason."""
    entries = []
    for step in steps:
        before, after = F.col(step.before), F.col(step.after)
        before_type, after_type = df.schema[step.before].dataType, df.schema[step.after].dataType
        entry = F.struct(
            F.lit(step.side).alias("side"),
            F.lit(step.field).alias("field"),
            V.as_text(before, before_type).alias("original"),
            V.as_text(after, after_type).alias("adjusted"),
            F.lit(step.reason).alias("reason"),
        )
        entries.append(F.when(changed(before, before_type, after, after_type), entry))
    kept = [F.col(f"`{c}`") for c in keep]
    if not entries:
        empty = F.array().cast(
            "array<struct<side:string,field:string,original:string,adjusted:string,reason:string>>"
        )
        return df.select(*kept, F.inline(empty))
    return df.select(*kept, F.inline(F.array_compact(F.array(*entries))))
