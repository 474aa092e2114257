"""Lookup append (left outer, last value wins) and the aggregation that feeds it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions import values as V

AGGREGATES = ("sum", "mean", "first", "last", "min", "max")
BLANK_SPREAD = 4096

KeyPair = str | tuple[str, str]


def parse_key_pairs(keys: str | Sequence[KeyPair]) -> list[tuple[str, str]]:
    """``"a,b=c"`` or its parts as (left column, right column) pairs."""
    if isinstance(keys, str):
        keys = [keys]
    pairs: list[tuple[str, str]] = []
    for entry in keys:
        if not isinstance(entry, str):
            pairs.append((entry[0], entry[1]))
            continue
        for part in filter(None, (p.strip() for p in entry.split(","))):
            left, _, right = part.partition("=")
            pairs.append((left.strip(), (right or left).strip()))
    if not pairs:
        raise ValueError("at least one key column is required")
    return pairs


def resolve_column(df: DataFrame, requested: str) -> str:
    """Exact name, or the first one equal after trimming and lower-casing."""
    if requested in df.columns:
        return requested
    wanted = requested.strip().lower()
    found = [c for c in df.columns if c.strip().lower() == wanted]
    if not found:
        raise ValueError(f"missing column {requested!r}; found {df.columns}")
    return found[0]


def _key_part(df: DataFrame, column: str, native: bool) -> Column:
    col = F.col(f"`{column}`")
    if native:
        return col
    text = V.as_text(col, df.schema[column].dataType)
    return F.coalesce(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), F.lit(""))


def _blank(parts: Sequence[Column], native: Sequence[bool]) -> Column:
    tests = [p.isNull() if n else p == "" for p, n in zip(parts, native)]
    return reduce(lambda a, b: a & b, tests)


def _order(order_by: str | Column | Sequence[str | Column]) -> Column:
    entries = [order_by] if isinstance(order_by, (str, Column)) else list(order_by)
    return F.struct(*[F.col(f"`{e}`") if isinstance(e, str) else e for e in entries])


def lookup_table(
    right: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    order_by: str | Column | Sequence[str | Column] | None,
    native: Sequence[bool],
) -> DataFrame:
    """Right side reduced to one row per key, the last one by ``order_by``, values as text.

    Without an order, the row with the greatest values stands for a repeated key. It is an aggregate, so rows are combined map-side and no key's rows are sorted in one task.
    """
    parts = [_key_part(right, k, n) for k, n in zip(keys, native)]
    named = [p.alias(f"__k{i}") for i, p in enumerate(parts)]
    kept = right.filter(~_blank(parts, native))
    picked = F.struct(*[F.col(f"`{v}`").alias(f"__v{i}") for i, v in enumerate(values)])
    # the greatest (order, values) pair: rows that tie on the order are settled by their values
    order = [] if order_by is None else [_order(order_by).alias("order")]
    last = F.max(F.struct(*order, picked.alias("values"))).alias("__last")
    table = kept.groupBy(*named).agg(last).select(*[f"__k{i}" for i in range(len(keys))], "__last.values.*")
    texts = [V.as_text(F.col(f"__v{i}"), right.schema[v].dataType).alias(f"__v{i}") for i, v in enumerate(values)]
    return table.select(*[f"__k{i}" for i in range(len(keys))], *texts)


def _resolved(left: DataFrame, right: DataFrame, keys: str | Sequence[KeyPair]):
    pairs = parse_key_pairs(keys)
    left_keys = [resolve_column(left, p[0]) for p in pairs]
    right_keys = [resolve_column(right, p[1]) for p in pairs]
    # two integer columns hold the same texts exactly when they hold the same numbers
    native = [
        V.is_integral(left.schema[a].dataType) and V.is_integral(right.schema[b].dataType)
        for a, b in zip(left_keys, right_keys)
    ]
    return left_keys, right_keys, native


def append_columns(
    left: DataFrame,
    right: DataFrame,
    keys: str | Sequence[KeyPair],
    values: Sequence[str],
    out: Sequence[str] | None = None,
    *,
    order_by: str | Column | Sequence[str | Column] | None = None,
    unique: bool = False,
) -> DataFrame:
    """Append right-hand values to every left row, as text, empty when there is none.

    Key parts are compared trimmed; an all-blank key matches nothing. When a key
    repeats on the right its last row by ``order_by`` wins; ``unique=True`` says
    that no order is needed because keys do not repeat, and where they do after
    all (trimmed keys may), the row with the greatest values wins. Either way
    every left row comes out once. Catalyst picks a broadcast or a sort-merge
    join from the size of the right side; a hot left key is split by adaptive
    skew handling, and blank keys are spread over tasks here.
    """
    if order_by is None and not unique:
        raise ValueError("order_by is required to say which of several rows of a key is the last one")
    left_keys, right_keys, native = _resolved(left, right, keys)
    columns = [resolve_column(right, v) for v in values]
    names = list(out) if out is not None else [v.lower() for v in values]
    if len(names) != len(columns):
        raise ValueError(f"{len(columns)} value columns but {len(names)} output names")
    taken = {c.strip().lower() for c in left.columns}
    clash = [n for n in names if n.strip().lower() in taken]
    if clash:
        raise ValueError(f"left side already has columns {clash}")

    table = lookup_table(right, right_keys, columns, order_by, native)
    parts = [_key_part(left, k, n) for k, n in zip(left_keys, native)]
    blank = _blank(parts, native)
    # blank keys match nothing; a stand-in per row keeps them from meeting in one task. A text
    # stand-in starts with a space, which no trimmed key does; the condition bars both kinds.
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(BLANK_SPREAD))
    stand_in = spread if native[0] else F.concat(F.lit(" "), spread.cast("string"))
    probes = {f"__p{i}": part for i, part in enumerate(parts)}
    probes["__p0"] = F.when(blank, stand_in).otherwise(parts[0])
    probe = left.withColumns({**probes, "__blank": blank})
    same = [F.col(f"__p{i}") == F.col(f"__k{i}") for i in range(len(parts))]
    joined = probe.join(table, reduce(lambda a, b: a & b, same, ~F.col("__blank")), "left")
    appended = [F.coalesce(F.col(f"__v{i}"), F.lit("")).alias(n) for i, n in enumerate(names)]
    return joined.select(*[F.col(f"`{c}`") for c in left.columns], *appended)


def repeated_keys(right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: lookup rows with a key, distinct keys, and rows a later one replaces."""
    resolved = [resolve_column(right, k) for k in keys]
    native = [V.is_integral(right.schema[k].dataType) for k in resolved]
    parts = [_key_part(right, k, n) for k, n in zip(resolved, native)]
    kept = right.filter(~_blank(parts, native))
    per_key = kept.groupBy(*[p.alias(f"__k{i}") for i, p in enumerate(parts)]).agg(F.count(F.lit(1)).alias("__rows"))
    return per_key.agg(
        F.coalesce(F.sum("__rows"), F.lit(0)).alias("lookup_rows"),
        F.count(F.lit(1)).alias("distinct_keys"),
        F.coalesce(F.sum(F.col("__rows") - 1), F.lit(0)).alias("replaced_rows"),
    )


def aggregate_by(
    df: DataFrame,
    index: Sequence[str],
    values: Sequence[str],
    function: str = "sum",
    *,
    order_by: str | Column | Sequence[str | Column] | None = None,
) -> DataFrame:
    """Group by ``index`` and reduce each value column with one function.

    Rows with a missing key are dropped, missing values are skipped, and the sum
    of nothing is 0. ``first`` and ``last`` need an explicit order.
    """
    if function not in AGGREGATES:
        raise ValueError(f"function must be one of {AGGREGATES}, got {function!r}")
    missing = [c for c in (*index, *values) if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    if function in ("first", "last") and order_by is None:
        raise ValueError(f"{function} needs order_by: a distributed table has no row order")

    def reduced(name: str) -> Column:
        col = V.clean(F.col(f"`{name}`"), df.schema[name].dataType)
        if function == "sum":
            total = F.sum(col)
            return F.coalesce(total, F.lit(0))
        if function == "mean":
            return F.avg(col)
        if function in ("min", "max"):
            return F.min(col) if function == "min" else F.max(col)
        ordered = F.when(col.isNotNull(), F.struct(_order(order_by).alias("order"), col.alias("value")))
        end = F.min(ordered) if function == "first" else F.max(ordered)  # rows without a value are skipped
        return end["value"]

    keyed = df.filter(reduce(lambda a, b: a & b, [~V.null_test(F.col(f"`{k}`"), df.schema[k].dataType) for k in index]))
    return keyed.groupBy(*[F.col(f"`{k}`") for k in index]).agg(*[reduced(v).alias(v) for v in values])


def append_aggregate(
    left: DataFrame,
    right: DataFrame,
    keys: str | Sequence[KeyPair],
    values: Sequence[str],
    out: Sequence[str] | None = None,
    function: str = "sum",
    *,
    order_by: str | Column | Sequence[str | Column] | None = None,
) -> DataFrame:
    """Aggregate the right side by its key columns, then append the result.

    Groups whose keys differ by blanks only are one key to the lookup; the last in key order wins.
    """
    index = [resolve_column(right, pair[1]) for pair in parse_key_pairs(keys)]
    columns = [resolve_column(right, v) for v in values]
    table = aggregate_by(right, index, columns, function, order_by=order_by)
    pairs = [(left_key, index[i]) for i, (left_key, _) in enumerate(parse_key_pairs(keys))]
    return append_columns(left, table, pairs, columns, out or [v.lower() for v in values], order_by=index)
