"""Report tables of a reconciliation. Every report is a lazy DataFrame with a fixed schema."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions import values as V
from tallymark.plans.reconcile import (
    DIFFERENT,
    MATCHED,
    MISSING_IN_SOURCE,
    MISSING_IN_TARGET,
    Reconciliation,
    Side,
)
from tallymark.plans.spec import SIDES, Field

# Labels of the summary report.
RUN_SECTION = "Run"
CONFIGURATION_SECTION = "Reconciliation Configuration"
STATISTICS_SECTION = "Reconciliation Statistics"
METADATA_LABELS = {
    "source_file": "Source File",
    "target_file": "Target File",
    "config_file": "Config File",
    "recon_date": "Recon Date",
    "execution_time": "Execution Time",
}
STATISTICS_LABELS = {
    "total_source": "Total Source Records",
    "total_target": "Total Target Records",
    "matched": "Matched Records",
    "different": "Different Records",
    "missing_in_source": "Missing in Source",
    "missing_in_target": "Missing in Target",
}


def diff_amount(s: Column, t: Column) -> Column:
    """Source minus target, of two numbers."""
    return s - t


def diff_percent(s: Column, t: Column) -> Column:
    """Difference as a percentage of the target's size; 0 when both are 0, otherwise nothing for target 0."""
    share = F.when(F.abs(t) > 0, (s - t) / F.abs(t) * 100).when(s == t, F.lit(0.0))
    rounded = V.round_half_even(share, 4)
    return F.when(~F.isnan(rounded), rounded)


def _pair_columns(df: DataFrame, field: Field) -> list[Column]:
    s, t = f"source_{field.name}", f"target_{field.name}"
    suffix = " (ignored)" if field.ignore else ""
    columns = [
        F.col(f"`{s}`").alias(f"Source: {field.name}{suffix}"),
        F.col(f"`{t}`").alias(f"Target: {field.name}{suffix}"),
    ]
    a, b = V.as_number(F.col(f"`{s}`"), df.schema[s].dataType), V.as_number(F.col(f"`{t}`"), df.schema[t].dataType)
    if field.diff_amount:
        columns.append(diff_amount(a, b).alias(f"Diff Amount: {field.name}"))
    if field.diff_percent:
        columns.append(diff_percent(a, b).alias(f"Diff %: {field.name}"))
    return columns


def _comparison(result: Reconciliation, category: str, *extra: str) -> DataFrame:
    df = result.records(category)
    keys = [F.col(f"`{n}`") for n in result.spec.key_names]
    pairs = [c for field in result.spec.visible_fields for c in _pair_columns(df, field)]
    return df.select(*keys, *pairs, *extra)


def matched_report(result: Reconciliation) -> DataFrame:
    return _comparison(result, MATCHED)


def different_report(result: Reconciliation) -> DataFrame:
    """Pairs of different records and the names of the fields that broke."""
    return _comparison(result, DIFFERENT, "diff_fields")


def _missing(result: Reconciliation, side: Side, category: str) -> DataFrame:
    df, at = result.raw_rows(category, side)
    shown = [f.name for f in result.spec.visible_fields if f.name in side.present_fields]
    return df.select(*[F.col(f"`{at[n]}`").alias(n) for n in (*result.spec.key_names, *shown)])


def missing_in_target_report(result: Reconciliation) -> DataFrame:
    """Source rows without a partner, values as before mapping."""
    return _missing(result, result.source, MISSING_IN_TARGET)


def missing_in_source_report(result: Reconciliation) -> DataFrame:
    """Target rows without a partner, values as before mapping."""
    return _missing(result, result.target, MISSING_IN_SOURCE)


def ordered_keys(result: Reconciliation) -> list[str]:
    """Key names in the order of the source table's columns, unknown ones last."""
    position = result.source.ordinals
    return [k.name for k in sorted(result.spec.keys, key=lambda k: position.get(k.source, math.inf))]


def ordered_fields(result: Reconciliation) -> list[str]:
    """Visible field names in the order of the source table's columns, unknown ones last."""
    position = result.source.ordinals
    shown = [f for f in result.spec.fields if not f.hidden]
    return [f.name for f in sorted(shown, key=lambda f: position.get(f.source, math.inf))]


def describe_filters(result: Reconciliation) -> list[str]:
    return [f"{side.title()}: {f.describe()}" for side in SIDES for f in result.spec.filters.get(side, ())]


def summary_report(result: Reconciliation, metadata: Mapping[str, str] | None = None) -> DataFrame:
    """Long table (position, section, label, value): run, configuration and record counts."""
    metadata = metadata or {}
    literal = [(RUN_SECTION, label, str(metadata.get(key, "N/A"))) for key, label in METADATA_LABELS.items()]
    literal += [
        (CONFIGURATION_SECTION, "Reconciliation Keys", ", ".join(ordered_keys(result)) or "N/A"),
        (CONFIGURATION_SECTION, "Configured Fields", ", ".join(ordered_fields(result)) or "N/A"),
        (CONFIGURATION_SECTION, "Data Filters", "\n".join(describe_filters(result)) or "None"),
    ]
    entries = [(F.lit(section), F.lit(label), F.lit(value)) for section, label, value in literal]
    entries += [
        (F.lit(STATISTICS_SECTION), F.lit(label), F.col(name).cast("string"))
        for name, label in STATISTICS_LABELS.items()
    ]
    rows = [
        F.struct(
            F.lit(i).alias("position"), section.alias("section"), label.alias("label"), value.alias("value")
        )
        for i, (section, label, value) in enumerate(entries)
    ]
    return result.summary().select(F.inline(F.array(*rows)))


def field_statistics_report(result: Reconciliation) -> DataFrame:
    """Field statistics with status, numbered in the order of the source table's columns."""
    position = result.source.ordinals
    names = [f.name for f in result.spec.compared_fields]
    ordered = sorted(names, key=lambda n: position.get(n, math.inf))
    stats = result.field_status()
    number = F.lit(len(ordered))
    for i, name in enumerate(ordered):
        number = F.when(F.col("field") == name, F.lit(i)).otherwise(number)
    return stats.select(
        number.alias("position"), "field", "matches", "differences", "comparable", "match_rate", "status"
    )


def _visible(result: Reconciliation, df: DataFrame) -> DataFrame:
    names = [f.name for f in result.spec.visible_fields]
    return df.filter(F.col("field").isin(names)) if names else df.limit(0)


def transformations_report(result: Reconciliation) -> DataFrame:
    """Value changes shown with matched and different records."""
    return _visible(result, result.joined_changes())


def adjustments_report(result: Reconciliation) -> DataFrame:
    """Post-join adjustments shown with matched and different records."""
    paired = result.adjustments().filter(F.col("category").isin(MATCHED, DIFFERENT))
    return _visible(result, paired)
