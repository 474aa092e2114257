"""JSON arrays, split within a file.

A file is cut at closing braces by Spark's text reader, so byte ranges of one array go to several
tasks. Whether a brace closes a record depends on what is open before it: a string, and how
many objects. Each range first tells what it does to that state, from outside and from inside
a string; one row a range is put in order, which gives the state each range begins with. With that,
ranges cut their records out side by side, and the few records that cross ranges are put together.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_MARKS = re.compile(r'\\.|["{]', re.S)


def part_state(part: str, in_string: bool) -> tuple[bool, int, int]:
    """What a part does: whether it ends in a string, how many objects it opens, and where the first one opens (-1: nowhere)."""
    opened, first = 0, -1
    for mark in _MARKS.finditer(part):
        what = mark.group()
        if what == '"':
            in_string = not in_string
        elif what == "{" and not in_string:
            opened += 1
            first = mark.start() if first < 0 else first
    return in_string, opened, first


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str]]:
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("file", "start", "value"))
        for file, start, value in zip(*columns, strict=True):
            yield (file, start), value


def read_json_array(spark: SparkSession, path: str | Sequence[str], schema: str | None = None) -> DataFrame:
    """The records of files that each hold an array of objects, or one object.

    Without a ``schema`` the records are written as lines first, from which types are inferred in
    parallel: to the session's checkpoint folder, or, where none is set, to the warehouse.
    """
    parts = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"
    )

    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, out = None, []
        for key, part in _ranges(batches):
            if key != own:
                out.append([*key, False, 0, True, 0])
                own = key
            row = out[-1]
            for k in (2, 4):
                row[k], opened, _ = part_state(part, row[k])
                row[k + 1] += opened - (not row[k])
        if out:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    names = ["file", "start", "out_string", "out_depth", "in_string", "in_depth"]
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64()]
    types = "file string, start long, out_string boolean, out_depth long, in_string boolean, in_depth long"
    begins: dict[tuple[str, int], tuple[bool, int]] = {}
    last, state = None, (False, 0)
    for file, start, *ends in sorted(map(tuple, parts.mapInArrow(effects, types).collect())):  # a row per range of bytes
        if file != last:
            last, state = file, (False, 0)
        begins[file, start] = state
        in_string, depth = ends[2:] if state[0] else ends[:2]
        state = in_string, state[1] + depth
    shared = spark.sparkContext.broadcast(begins)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, in_string, depth, began, order = None, [], False, 0, True, 0
        out: list[tuple] = []

        def piece(text: str, ends: bool) -> None:
            # a whole record, or the beginning, middle or end of one that crosses ranges
            nonlocal order
            order += 1
            out.append((*own, order, began, ends, text))

        for key, part in _ranges(batches):
            if key != own:
                if held:
                    piece("".join(held), False)
                own, held, order = key, [], 0
                in_string, depth = shared.value[key]
                began = depth == 0
            in_string, opened, first = part_state(part, in_string)
            if depth == 0 and opened:
                part, began = part[first:], True
            if depth or opened:
                held.append(part + "}")
                depth += opened - (not in_string)
                if depth == 0:
                    piece("".join(held), True)
                    held, began = [], True
            if len(out) >= 5000:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), piece_kinds)], names=piece_names)
                out.clear()
        if held:
            piece("".join(held), False)
        if out:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), piece_kinds)], names=piece_names)

    piece_names = ["file", "start", "place", "begins", "ends", "text"]
    piece_kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]
    pieces = parts.mapInArrow(cut, "file string, start long, place long, begins boolean, ends boolean, text string")
    whole = pieces.filter("begins and ends").select("text")
    # two pieces a range at most
    torn = pieces.filter("not (begins and ends)")
    record = F.sum(F.col("begins").cast("int")).over(Window.partitionBy("file").orderBy("start", "place"))
    torn = torn.withColumn("record", record).groupBy("file", "record").agg(
        F.array_sort(F.collect_list(F.struct("start", "place", "text"))).alias("parts")
    )
    torn = torn.select(F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))
    records = whole.union(torn)
    if schema is not None:
        return records.select(F.from_json("text", schema).alias("r")).select("r.*")
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
    lines = f"{folder.rstrip('/')}/json-lines-{uuid.uuid4().hex}"
    # line breaks stand between tokens only, as strings have them escaped
    records.select(F.translate("text", "\r\n", "  ").alias("value")).write.text(lines)
    return spark.read.json(lines)
