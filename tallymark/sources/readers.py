"""File sources: CSV, JSON, Parquet, and the newest file of a pattern."""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from pathlib import PurePosixPath
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions.values import NUMBER_PATTERN
from tallymark.operators.quality import check_dataset
from tallymark.sources.arrays import read_json_array

# Delimiters looked for, and texts read as missing.
DELIMITERS = (",", ";", "\t", "|")
NULL_TOKENS = (
    "", "NULL", "null", "N/A", "n/a", "NaN", "nan", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "NA", "None",
)
TRUE_TEXTS = ("True", "TRUE", "true")
FALSE_TEXTS = ("False", "FALSE", "false")

HEAD_LINES = 64
_WHOLE = r"^\s*[+-]?\d{1,19}\s*$"


def detect_delimiter(spark: SparkSession, path: str | Sequence[str], encoding: str = "UTF-8") -> str:
    """Delimiter of a CSV, from its first lines only."""
    head = spark.read.option("encoding", encoding).text(path).limit(HEAD_LINES).collect()  # a bounded sample
    lines = [row[0] for row in head]
    if not lines:
        raise ValueError(f"{path} is empty")
    try:
        return csv.Sniffer().sniff("\n".join(lines), delimiters="".join(DELIMITERS)).delimiter
    except csv.Error:
        counts = {d: lines[0].count(d) for d in DELIMITERS}
        best = max(counts, key=counts.get)
        return best if counts[best] else ","


@dataclass(frozen=True)
class Survey:
    """What one pass over the raw lines of CSV files tells."""

    headers: dict[str, list[str]]  # the files of each header line
    longer: bool  # a line has more cells than its file's header
    open_quote: bool  # a line ends within a quoted cell


def scan_cells(line: Column, delimiter: str, wanted: int = 0) -> Column:
    """How the reader sees a line: its ``cells``, whether its end is ``quoted``, and ``beyond``, where cell ``wanted`` + 1 begins.

    The line is cut at delimiters and quotes, and one pass over the parts follows the state: at
    the start of a cell, in a plain cell, where quotes are text, in a quoted cell, or behind a
    quote in one, which ends it unless another quote follows.
    """
    first = re.escape(delimiter[0])
    parts = F.regexp_extract_all(line, F.lit(f'"|{re.escape(delimiter)}|[^"{first}]+|{first}'), F.lit(0))
    start = F.struct(
        F.lit(0).alias("state"), F.lit(1).alias("cells"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("beyond")
    )

    def step(seen: Column, part: Column) -> Column:
        state, quote = seen["state"], part == '"'
        ends = (part == delimiter) & (state != 2)
        at = seen["at"] + F.length(part)
        following = (
            F.when(ends, 0).when(quote & (state == 0), 2).when(quote & (state == 2), 3).when(quote & (state == 3), 2)
            .when(state == 2, 2).otherwise(1)
        )
        beyond = F.when(ends & (seen["cells"] == wanted), at).otherwise(seen["beyond"])
        return F.struct(
            following.alias("state"), (seen["cells"] + ends.cast("int")).alias("cells"), at.alias("at"), beyond.alias("beyond")
        )

    return F.aggregate(
        parts, start, step, lambda seen: F.struct(seen["cells"].alias("cells"), (seen["state"] == 2).alias("quoted"), seen["beyond"].alias("beyond"))
    )


def survey_csv(spark: SparkSession, path: str | Sequence[str], delimiter: str, encoding: str = "UTF-8") -> Survey:
    """One pass over the raw lines; a row per file comes back. Only lines with quotes are scanned part by part."""
    lines = spark.read.option("encoding", encoding).text(path).select(
        F.col("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("place"),  # rises within a block
    ).filter(F.trim("value") != "")
    scanned = F.when(F.contains("value", F.lit('"')), scan_cells(F.col("value"), delimiter))
    plain = (F.length("value") - F.length(F.replace(F.col("value"), F.lit(delimiter), F.lit("")))) / len(delimiter) + 1
    counted = lines.withColumn("scan", scanned).select(
        "value", "file", "place", "start",
        F.coalesce("scan.cells", plain.cast("int")).alias("cells"), F.coalesce("scan.quoted", F.lit(False)).alias("quoted"),
    )
    head = F.when(F.col("start") == 0, F.col("place"))  # nulls do not count: the first line of the first block
    files = counted.groupBy("file").agg(
        F.min_by("value", head).alias("header"), F.min_by("cells", head).alias("wanted"),
        F.max("cells").alias("most"), F.max("quoted").alias("quoted"),
    ).collect()
    headers: dict[str, list[str]] = {}
    for row in sorted(files, key=lambda r: r["file"]):
        headers.setdefault(row["header"], []).append(row["file"])
    return Survey(headers, any(r["most"] > r["wanted"] for r in files), any(r["quoted"] for r in files))


def read_text_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    *,
    sep: str | None = None,
    encoding: str = "UTF-8",
    multi_line: bool | None = None,
    extra: str | None = None,
    headers: str = "refuse",
    survey: bool = True,
) -> DataFrame:
    """CSV with every column as text, exactly as written; missing and empty fields are empty text.

    The delimiter is told from the first lines, as a spreadsheet would; if lines then have more
    cells than the header, and with a comma none has, it is the comma. Give ``sep`` to be sure.
    Line breaks in quoted cells are looked for unless ``multi_line`` is given; files that have
    some are read whole, one task a file.

    Nothing is lost silently: reading fails on a row with more cells than the header, unless
    ``extra`` names a column that takes the text of the further cells, and on files with differing
    headers, unless ``headers="by_name"``: columns are then placed by name, and one that a file lacks is empty
    text there. All this takes one pass over the raw lines; ``survey=False`` spares it for files
    known to have one header and no quoted line breaks.
    """
    if headers not in ("by_name", "refuse"):
        raise ValueError(f"headers must be 'by_name' or 'refuse', got {headers!r}")
    delimiter = sep or detect_delimiter(spark, path, encoding)
    found = None
    if survey:
        found = survey_csv(spark, path, delimiter, encoding)
        if sep is None and delimiter != "," and found.longer and not found.open_quote:
            other = survey_csv(spark, path, ",", encoding)
            if not other.longer:
                delimiter, found = ",", other
        if multi_line is None:
            multi_line = found.open_quote
    groups = list(found.headers.values()) if found else []
    options = {"delimiter": delimiter, "encoding": encoding, "multi_line": bool(multi_line), "extra": extra}
    if len(groups) > 1 and headers == "by_name":
        tables = [_one_header(spark, files, **options) for files in groups]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables).na.fill("")
    if len(groups) > 1:
        raise ValueError(f"files with differing headers: {[files[0] for files in groups]}")
    return _one_header(spark, path, **options).na.fill("")


def _one_header(
    spark: SparkSession, path: str | Sequence[str], *, delimiter: str, encoding: str, multi_line: bool, extra: str | None
) -> DataFrame:
    def reader():
        return (
            spark.read.option("header", True)
            .option("sep", delimiter)
            .option("encoding", encoding)
            .option("quote", '"')
            .option("escape", '"')
            .option("multiLine", multi_line)
        )

    names = reader().csv(path).columns
    line = "__line"
    fields = [T.StructField(n, T.StringType()) for n in (*names, line)]
    strict = reader().option("enforceSchema", False).option("columnNameOfCorruptRecord", line).option("columnPruning", False)
    rows = strict.schema(T.StructType(fields)).csv(path)
    # Spark keeps the line of a row that has another number of cells than the header
    beyond = F.when(F.col(line).isNotNull(), scan_cells(F.col(line), delimiter, len(names))["beyond"])
    if extra is not None:
        rows = rows.withColumn(extra, F.substring(F.col(line), beyond + 1, F.length(line)))
    else:
        message = F.concat(F.lit("more cells than the header has: "), F.substring(line, 1, 200))
        rows = rows.filter(F.when(beyond.isNotNull(), F.raise_error(message).cast("boolean")).otherwise(True))
    return rows.drop(line)


def null_out_tokens(df: DataFrame, tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """Turn texts that stand for a missing value into NULL."""
    def kept(name: str) -> Column:
        col = F.col(f"`{name}`")
        return F.when(~col.isin(*tokens), col).alias(name)

    return df.select(*[kept(c) for c in df.columns])


def infer_types(df: DataFrame) -> DataFrame:
    """Give all-text columns the narrowest of integer, number, flag or text that every value fits.

    One pass counts, per column, the values each type can read.
    """
    tests = []
    for i, name in enumerate(df.columns):
        col = F.col(f"`{name}`")
        whole = col.rlike(_WHOLE) & F.trim(col).try_cast("bigint").isNotNull()
        tests += [
            F.count(col).alias(f"n{i}"),
            F.count_if(whole).alias(f"l{i}"),
            F.count_if(col.rlike(NUMBER_PATTERN)).alias(f"d{i}"),
            F.count_if(col.isin(*TRUE_TEXTS, *FALSE_TEXTS)).alias(f"b{i}"),
        ]
    counts = df.agg(*tests).first()
    columns = []
    for i, name in enumerate(df.columns):
        col, filled = F.col(f"`{name}`"), counts[f"n{i}"]
        if filled and counts[f"l{i}"] == filled:
            col = F.trim(col).try_cast("bigint")
        elif filled and counts[f"d{i}"] == filled:
            col = F.trim(col).try_cast("double")
        elif filled and counts[f"b{i}"] == filled:
            col = F.when(col.isNotNull(), col.isin(*TRUE_TEXTS))
        columns.append(col.alias(name))
    return df.select(*columns)


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    *,
    sep: str | None = None,
    encoding: str = "UTF-8",
    multi_line: bool | None = None,
    schema: str | None = None,
    unreadable: str = "null",
    headers: str = "refuse",
    survey: bool = True,
) -> DataFrame:
    """CSV with missing-value texts nulled and column types inferred.

    A ``schema`` in DDL form skips the inference pass; give one for large files. A cell that its
    type cannot read is then missing; ``unreadable="raise"`` fails the read instead, and
    ``unreadable_cells`` counts them.
    """
    if unreadable not in ("raise", "null"):
        raise ValueError(f"unreadable must be 'raise' or 'null', got {unreadable!r}")
    text = read_text_csv(spark, path, sep=sep, encoding=encoding, multi_line=multi_line, headers=headers, survey=survey)
    df = null_out_tokens(text)
    if schema is None:
        return infer_types(df)
    wanted = spark.createDataFrame([], schema).schema

    def typed(field: T.StructField) -> Column:
        col = F.col(f"`{field.name}`")
        value = F.trim(col).try_cast(field.dataType)
        if unreadable == "raise":
            message = F.concat(F.lit(f"{field.name} is no {field.dataType.simpleString()}: "), col)
            value = F.when(col.isNotNull() & value.isNull(), F.raise_error(message).cast(field.dataType)).otherwise(value)
        return value.alias(field.name)

    return df.select(*[typed(f) for f in wanted.fields])


def unreadable_cells(
    spark: SparkSession, path: str | Sequence[str], schema: str, *, sep: str | None = None, encoding: str = "UTF-8"
) -> DataFrame:
    """One row per column of ``schema``: how many filled cells of a CSV its type cannot read."""
    df = null_out_tokens(read_text_csv(spark, path, sep=sep, encoding=encoding))
    fields = spark.createDataFrame([], schema).schema.fields
    counts = [F.count_if(F.col(f"`{f.name}`").isNotNull() & F.trim(F.col(f"`{f.name}`")).try_cast(f.dataType).isNull()) for f in fields]
    row = df.agg(F.array(*[F.struct(F.lit(f.name).alias("column"), n.alias("unreadable")) for f, n in zip(fields, counts)]).alias("c"))
    return row.select(F.inline("c"))


def read_json(
    spark: SparkSession, path: str | Sequence[str], *, lines: bool = False, schema: str | None = None
) -> DataFrame:
    """JSON: an array of records, or one record per line; both are read in parallel.

    Types are inferred over all records unless a ``schema`` in DDL form is given.
    """
    if lines:
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.json(path)
    return read_json_array(spark, path, schema)


def read_parquet(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return spark.read.parquet(path)


# File extensions and their formats.
READERS = {".csv": read_csv, ".json": read_json, ".parquet": read_parquet}


def load(spark: SparkSession, path: str, *, check: bool = True, **options: Any) -> DataFrame:
    """Read a file or folder by its extension, then check it holds rows."""
    extension = PurePosixPath(path.rstrip("/")).suffix.lower()
    if extension not in READERS:
        raise ValueError(f"unsupported format {extension!r}; use one of {sorted(READERS)}")
    df = READERS[extension](spark, path, **options)
    return check_dataset(df, path) if check else df


def latest_file(
    spark: SparkSession, folders: str | Sequence[str], patterns: str | Sequence[str], *, required: bool = True
) -> str | None:
    """Path of the newest file matching any pattern in any of the folders.

    Only file names and times are listed; contents are never read.
    """
    folders = [folders] if isinstance(folders, str) else list(folders)
    patterns = [patterns] if isinstance(patterns, str) else list(patterns)
    glob = "{" + ",".join(patterns) + "}" if len(patterns) > 1 else patterns[0]
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folders)
    newest = files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path")).first()["path"]
    if newest is None and required:
        raise FileNotFoundError(f"no file matching {glob!r} in {folders}")
    return newest
