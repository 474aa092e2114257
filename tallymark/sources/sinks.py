"""Where results go: one table per report, the classified table, enriched CSV."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame

from tallymark.plans import reports
from tallymark.plans.reconcile import Reconciliation

FORMATS = ("parquet", "orc", "json", "csv")


def write_table(df: DataFrame, path: str, *, format: str = "parquet", partition_by: Iterable[str] = ()) -> str:
    if format not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}, got {format!r}")
    writer = df.write.mode("overwrite").format(format)
    if format == "csv":
        writer = writer.option("header", True)
    columns = list(partition_by)
    (writer.partitionBy(*columns) if columns else writer).save(path)
    return path


def write_classified(result: Reconciliation, path: str, *, format: str = "parquet") -> str:
    """All joined rows in one pass, one folder per category."""
    return write_table(result.classified(), path, format=format, partition_by=["category"])


def write_reports(
    result: Reconciliation, path: str, *, metadata: Mapping[str, str] | None = None, format: str = "parquet"
) -> dict[str, str]:
    """The five reports and the field statistics, each as a table under ``path``.

    The compared rows are written to ``path/compared`` first, so the join runs once.
    """
    base = path.rstrip("/")
    result = result.materialize(f"{base}/compared")
    tables = {
        "summary": reports.summary_report(result, metadata),
        "field_statistics": reports.field_statistics_report(result),
        "matched": reports.matched_report(result),
        "different": reports.different_report(result),
        "missing_in_target": reports.missing_in_target_report(result),
        "missing_in_source": reports.missing_in_source_report(result),
    }
    return {name: write_table(df, f"{base}/{name}", format=format) for name, df in tables.items()}


def write_enriched(df: DataFrame, path: str, *, sep: str = ",", encoding: str = "UTF-8", bom: bool = True) -> str:
    """All-text rows as CSV with a header, values as they were read.

    Files in UTF-8 begin with a byte order mark, as spreadsheets expect, unless the first
    column's name has to be quoted; readers pass over it.
    """
    first = df.columns[0]
    if bom and encoding.upper() == "UTF-8" and not any(c in first for c in (sep, '"', "\n", "\r")) and first.strip() == first:
        df = df.withColumnRenamed(first, "\ufeff" + first)
    text = df.write.mode("overwrite").option("header", True).option("sep", sep).option("encoding", encoding)
    text.option("quote", '"').option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(path)
    return path
